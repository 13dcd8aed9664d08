"""License scans by canonical digests: entire texts, and entire lines of them, are normalised and hash-joined to known licence digests."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import read, text_of

#: Equivalent spellings, in order; whole words of the normal form.
SPELLINGS = (
    (r"\blicence(s?)\b", "license$1"),
    (r"\blicenced\b", "licensed"),
    (r"\bsub license\b", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\borganisation(s?)\b", "organization$1"),
    (r"\bcopyright holders?\b", "copyright holder"),
    (r"\bcopyright owners?\b", "copyright holder"),
    (r"\bversion (\d)", "v$1"),
    (r"\bv ?(\d)", "v$1"),
    (r"\bcreative commons attribution noncommercial\b", "cc by nc"),
    (r"\bgnu general public license\b", "gnu gpl"),
)

#: How a text begins that one of the spellings changes at its start.
_CHANGED = "licen|sub|non|organi|copyright|v|creative|gnu"

#: Texts of well-known licences and notices.
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}mozilla.org/MPL/2.0/."
_GNU_NOTICE = """{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details.

You should have received a copy of the GNU {kind} General Public License along with {it}. If not, see <{scheme}://www.gnu.org/licenses/>."""
_GNU_KINDS = (("GPL-3.0-or-later", "", "3"), ("LGPL-3.0-or-later", "Lesser", "3"), ("AGPL-3.0-or-later", "Affero", "3"))
#: One-line notices: the licence's name in full and in short, and its SPDX name.
_NAMES = (
    ("MIT License", "MIT"),
    ("ISC License", "ISC"),
    ("Apache License, Version 2.0", "Apache-2.0"),
    ("GNU General Public License, version 2", "GPL-2.0-only"),
    ("GNU General Public License, version 3", "GPL-3.0-only"),
    ("GNU Lesser General Public License, version 2.1", "LGPL-2.1-only"),
    ("GNU Lesser General Public License, version 3", "LGPL-3.0-only"),
    ("GNU Affero General Public License, version 3", "AGPL-3.0-only"),
    ("Mozilla Public License, version 2.0", "MPL-2.0"),
    ("Eclipse Public License, version 2.0", "EPL-2.0"),
    ("Boost Software License, version 1.0", "BSL-1.0"),
    ("BSD 2-Clause License", "BSD-2-Clause"),
    ("BSD 3-Clause License", "BSD-3-Clause"),
    ("CC0 1.0 Universal license", "CC0-1.0"),
    ("CC BY 4.0", "CC-BY-4.0"),
    ("CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
)
_SAID = ("Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "SPDX-License-Identifier: {id}")
KNOWN_TEXTS = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("MIT-0", _MIT_BODY.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n", "")),
    ("0BSD", _0BSD),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_3 + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
    *(("MPL-2.0", _MPL_NOTICE.format(scheme)) for scheme in ("http://", "https://")),
    *((name, _GNU_NOTICE.format(what=what, it=it, kind=kind, version=version, scheme=scheme)) for name, kind, version in _GNU_KINDS for what, it in (("This program", "this program"), ("This file", "this file")) for scheme in ("http", "https")),
    *((name, said.format(full, id=name)) for full, name in _NAMES for said in _SAID),
)

#: Licence, digest of the normal form of its whole text as published, and that form's first word.
KNOWN_DIGESTS = (
    ("Apache-2.0", "86d31cdc53c9d9a4bf6464a04a69ceb2", "apache"),
    ("Artistic-1.0-Perl", "7cd9999cbad5593263e76db78f83bc02", "the"),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23", "creative"),
    ("GFDL-1.2-or-later", "2cd96a94fc2fab8b4027b7dbb54190ce", "gnu"),
    ("GFDL-1.3-or-later", "af5b6afcc2ea219cffa3313d6b9b65cb", "gnu"),
    ("GPL-1.0-only", "081e351ecf920032feb41e6e5dc87bce", "gnu"),
    ("GPL-2.0-only", "03cc79d2788d7ca2707d61b5d91a3df9", "gnu"),
    ("GPL-3.0-only", "c325e2ebcd30031f0ea0125a2c8a6182", "gnu"),
    ("LGPL-2.0-only", "ab022a4867fff8e2a0d06f7a167e5b8a", "gnu"),
    ("LGPL-2.1-only", "feda4e37f84ddeb511ac318e13d96417", "gnu"),
    ("LGPL-3.0-only", "23064fa723305017753c64ef5cfabec9", "gnu"),
    ("MPL-1.1", "9f71e497fe6b535f53ac50c7985090bb", "mozilla"),
    ("MPL-2.0", "498553ad70c8d4702bd3fed86440ba18", "mozilla"),
)

#: "copyright" before one of these words is no statement of a holder; it is set apart by a tilde, which is punctuation.
_SPOKEN = r"\bcopyright[ \t]+(notices?|holders?|owners?|licen[sc]es?|laws?|interests?|statements?|acts?|and|or|on|in|is|of|to|the|for|protection|infringement|treaty|status|permission)\b"
#: Lines that state a holder, with or without a year, with the far indented lines below them that go on with it, and lines that reserve all rights; the tilde keeps body lines.
_COPYRIGHT = r"(?m)^[^\na-z]{0,8}(?:(?:portions )?copyright(?:[ \t]+[^~\n \t]|[(:,©\d])[^\n]*|\(c\)[^\n]*\d{4}[^\n]*|©[^\n]*|all rights reserved[^\na-z]{0,8})(?:\n[ \t]{8,}[^\n]*)*$"
_NOT_WORD = r"[^a-z0-9]+"


def canonical(text: str) -> str:
    """The normal form, as canonical_column has it."""
    t = re.sub(_COPYRIGHT, " ", re.sub(_SPOKEN, r"copyright~\1", text.lower()))
    t = re.sub(_NOT_WORD, " ", t).strip(" ")
    for old, new in SPELLINGS:
        t = re.sub(old, new.replace("$1", r"\1"), t)
    return t


def bare_column(text: Column) -> Column:
    """Lower case, without lines that state copyright or reserve all rights, punctuation and blanks as one space."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), _SPOKEN, "copyright~$1"), _COPYRIGHT, " ")
    return F.trim(F.regexp_replace(t, _NOT_WORD, " "))


def spelled_column(bare: Column) -> Column:
    for old, new in SPELLINGS:
        bare = F.regexp_replace(bare, old, new)
    return bare


def canonical_column(text: Column) -> Column:
    """bare_column with spellings made equal."""
    return spelled_column(bare_column(text))


def digest_of(text: str) -> tuple[str, str]:
    """(digest, first word) of a text's normal form, as KNOWN_DIGESTS has them."""
    form = canonical(text)
    return hashlib.md5(form.encode()).hexdigest(), form.split(" ")[0]


def known_digests(texts=KNOWN_TEXTS, more=KNOWN_DIGESTS) -> list[tuple[str, str]]:
    """(digest, licence), one for each normal form."""
    return sorted({(digest_of(t)[0], name) for name, t in texts} | {(digest, name) for name, digest, _ in more})


def find_licenses(docs: DataFrame, texts=KNOWN_TEXTS, more=KNOWN_DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and licence found: id_col, license, whole (the entire text is the licence), lines (lines that are its notice).

    Every entire text and every entire line is looked up, whatever its length; a licence inside a longer
    line is not found. Only units that begin like a known text, or like one that the spellings change at
    its start, have their spellings made equal and are hashed; no other unit can become a known text. texts are (licence, text) pairs, more
    (licence, digest, first word) triples of longer ones as digest_of gives them, both to be extended at
    will: only digests are sent out.
    Null and empty texts hold none. A document's repeated rows each count; an empty table gives
    no rows; other columns, whatever their names, are left out. The known digests are a fixed
    list, hence the broadcast.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(known_digests(texts, more), "digest string, license string")
    heads = "|".join(sorted({digest_of(t)[1] for _, t in texts} | {head for _, _, head in more}))
    begins = rf"^(?:(?:{heads})(?: |$)|{_CHANGED})"
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    unit = lambda x, whole, is_text: F.struct(whole.alias("whole"), F.lit(is_text).alias("is_text"), bare_column(x).alias("bare"))
    entire = F.when(F.contains("text", F.lit("\n")), F.array(unit(F.col("text"), F.lit(True), True))).otherwise(F.expr("cast(array() as array<struct<whole:boolean,is_text:boolean,bare:string>>)"))
    lines = F.transform(F.split("text", "\n", -1), lambda x: unit(x, x == F.col("text"), False))
    units = F.concat(*[F.filter(u, lambda x: x["bare"].rlike(begins)) for u in (entire, lines)])
    rows = d.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.whole", "u.is_text", F.md5(spelled_column(F.col("u.bare")).cast("binary")).alias("digest"))
    hits = rows.join(F.broadcast(table), "digest")
    return hits.groupBy("doc_id", "license").agg(F.max("whole").alias("whole"), F.count_if(~F.col("is_text")).alias("lines")).withColumnRenamed("doc_id", id_col)


def op9_license_digest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by entire text and by entire lines; no row for documents without one. Null and empty texts have none; repeated rows of an id add up their lines."""
    return find_licenses(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op9: the same normal form and digests over all lines and texts."""
    norm = f"regexp_replace(regexp_replace(lower(u), '{_SPOKEN}', 'copyright~{chr(92)}1', 'g'), '{_COPYRIGHT}', ' ', 'g')"
    norm = f"trim(regexp_replace({norm}, '{_NOT_WORD}', ' ', 'g'), ' ')"
    for old, new in SPELLINGS:
        norm = f"regexp_replace({norm}, '{old}', '{new.replace('$1', chr(92) + '1')}', 'g')"
    known = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, t = u AS whole, false AS is_text, u FROM (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS u FROM d)
      UNION ALL SELECT doc_id, true, true, t FROM d WHERE contains(t, chr(10))),
k(digest, license) AS (VALUES {known})
SELECT doc_id, license, bool_or(whole) AS whole, CAST(count(*) FILTER (WHERE NOT is_text) AS BIGINT) AS lines
FROM (SELECT doc_id, whole, is_text, md5({norm}) AS digest FROM u) JOIN k USING (digest) GROUP BY doc_id, license"""
