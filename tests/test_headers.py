"""Headers of images and videos made here, whole and broken."""

import io
import struct
import zlib

import pytest

from skyledger.sources import headers


def png(w, h):
    body = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def jpeg(w, h, marker=0xC2):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10 + b"\xff\xff\xc4" + struct.pack(">H", 5) + b"abc" + bytes([0xFF, marker]) + struct.pack(">HBHH", 17, 8, h, w) + b"\0" * 10


def box(name, *inner, wide=False):
    body = b"".join(inner)
    return struct.pack(">I4sQ", 1, name, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), name) + body


def clock(scale, ticks, version=0):
    return b"\1\0\0\0" + struct.pack(">QQIQ", 0, 0, scale, ticks) if version else b"\0\0\0\0" + struct.pack(">IIII", 0, 0, scale, ticks)


def track(kind, w, h, scale, ticks, times, version=0):
    stts = struct.pack(">II", 0, len(times)) + b"".join(struct.pack(">II", n, d) for n, d in times)
    return box(b"trak", box(b"tkhd", b"\0" * 76, struct.pack(">II", w << 16, h << 16)), box(b"mdia", box(b"mdhd", clock(scale, ticks, version)), box(b"hdlr", b"\0" * 8, kind, b"\0" * 12), box(b"minf", box(b"stbl", box(b"stts", stts)))))


def mp4(moov_last=True, **how):
    sound = track(b"soun", 0, 0, 48_000, 480_000, [(10, 1024)])
    moov = box(b"moov", box(b"mvhd", clock(1000, 10_000)), sound, track(b"vide", 1280, 720, 30_000, 300_300, [(299, 1001), (1, 1001)], **how))
    data = box(b"mdat", b"x" * 5000, wide=True)
    return box(b"ftyp", b"isom\0\0\0\0") + (data + moov if moov_last else moov + data)


def avi(w, h, frames, micros):
    return b"RIFF" + struct.pack("<I", 100) + b"AVI LIST" + struct.pack("<I", 80) + b"hdrlavih" + struct.pack("<11I", 56, micros, 0, 0, 0, frames, 0, 1, 0, w, h)


WEBP = {
    "x": b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0" + b"\0" * 4 + (299).to_bytes(3, "little") + (199).to_bytes(3, "little"),
    "l": b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 299 | 199 << 14),
    "k": b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300, 200),
}
TIFF = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHI", 256, 3, 1) + struct.pack(">HH", 640, 0) + struct.pack(">HHII", 257, 4, 1, 480)


def test_images():
    size = lambda b: headers.image_size(io.BytesIO(b))
    assert size(png(1920, 1080)) == ("png", 1920, 1080) and size(jpeg(641, 479)) == ("jpeg", 641, 479)
    assert size(b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 33, -22)) == ("bmp", 33, 22) and size(TIFF) == ("tiff", 640, 480)
    assert {k: size(b) for k, b in WEBP.items()} == {k: ("webp", 300, 200) for k in WEBP}
    for broken in (b"", png(1, 1)[:20], jpeg(1, 1, 0xDA), b"\xff\xd8abcdefgh", b"not an image", jpeg(5, 5)[:30]):
        with pytest.raises(headers.Unreadable):
            size(broken)


@pytest.mark.parametrize("how", [{}, {"moov_last": False}, {"version": 1}])
def test_videos(how):
    b = mp4(**how)
    kind, w, h, frames, seconds, rate = headers.video_metadata(io.BytesIO(b), len(b))
    assert (kind, w, h, frames) == ("mp4", 1280, 720, 300) and seconds == pytest.approx(10.01) and rate == pytest.approx(29.97, abs=1e-3)


def test_broken_videos():
    good = mp4()
    for b, why in ((good[:-40], "leaves"), (box(b"ftyp", b"isom") + box(b"mdat", b"x" * 10), "no movie"), (box(b"ftyp", b"isom") + box(b"moov", track(b"soun", 0, 0, 1, 1, [])), "no video"), (b"\x1aE\xdf\xa3" + b"\0" * 20, "unknown"), (b"RIFF\0\0\0\0AVI LIST", "cut short")):
        with pytest.raises(headers.Unreadable, match=why):
            headers.video_metadata(io.BytesIO(b), len(b))


def test_table(spark, tmp_path):
    (tmp_path / "a").mkdir()
    files = {"a/x.PNG": png(10, 20), "a/y.jpg": jpeg(30, 40), "v.mp4": mp4(), "w.avi": avi(320, 240, 50, 40_000), "broken.jpeg": b"\xff\xd8\xff", "short.mov": b"abc", "notes.txt": b"png"}
    for name, b in files.items():
        (tmp_path / name).write_bytes(b)
    got = {r.path.split(f"{tmp_path}/")[1]: r for r in headers.media_headers(spark, str(tmp_path), files_per_task=2).collect()}
    assert set(got) == set(files) - {"notes.txt"}
    assert (got["a/x.PNG"].width, got["a/x.PNG"].height, got["a/x.PNG"].frames) == (10, 20, None) and (got["w.avi"].frames, got["w.avi"].duration_s, got["w.avi"].fps) == (50, 2.0, 25.0)
    assert got["v.mp4"].frames == 300 and got["v.mp4"].length == len(files["v.mp4"])
    assert got["broken.jpeg"].reason and got["short.mov"].reason == "cut short" and got["broken.jpeg"].width is None
