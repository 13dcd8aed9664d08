"""Hand-overs and recoveries on courses of events whose outcome is known, and over the adapter's events."""

from skyledger.operators import coordination as c

P = c.CoordinationParams()


def test_handover():
    h = c.Handover(P)
    assert h.trigger(0, (0, 0), [(5, 9.0, 1.0), (6, 1.0, 0.0)]) == "no receiver"
    assert h.trigger(0, (0, 0), [(5, 9.0, 1.0), (7, 1.0, 0.5)]) == "triggered" and h.to == 7
    assert h.trigger(1, (0, 0), [(8, 0.1, 1.0)]) == "" and h.to == 7
    assert h.see(3, (0, 0), None) == "" and h.see(7, (1, 0), 0.9) == "confirming"
    assert h.see(7, (40, 0), None) == "disagreed" and h.confirmed == 0
    h.move((40, 0))
    assert [h.see(7, (41, 0), a) for a in (0.6, None, 0.5)] == ["confirming", "confirming", "disagreed"]
    assert [h.see(7, (41, 0), None) for _ in range(3)] == ["confirming", "confirming", "completed"] and h.to is None
    h.trigger(10, (0, 0), [(7, 1.0, 0.5)])
    assert h.expire(10 + 135) == "" and h.expire(10 + 136) == "failed" and h.to is None


def test_recovery():
    r = c.Recovery(P)
    assert not r.wanted(3, "confirmed") and not r.wanted(9, "tentative") and not r.wanted(9, "dead") and r.wanted(4, "lost")
    r.begin(100, (0, 0))
    assert not r.wanted(9, "lost")
    assert r.search(100, 2.0, [1, 2, 3, 4, 5, 6, 7, 8]) == ("searched", 8.0, [1, 2, 3, 4, 5, 6], False)
    assert r.search(103, 20.0, [1, 2]) == ("searched", 32.0, [1, 2], True)
    assert r.search(104, 90.0, []) == ("nobody sees", 0.0, [], False)
    assert not r.find((33, 0), None) and not r.find((30, 0), 0.5) and r.find((30, 0), 0.6) and r.started is None
    r.begin(0, (0, 0))
    assert r.search(46, 1.0, [1])[0] == "exhausted" and r.started is None


def plain(events, until):
    """Every identity's frames one by one, its clock ticking whether or not there are events."""
    out = []
    for gid in {e.gid for e in events}:
        own = sorted((e for e in events if e.gid == gid), key=lambda e: (e.frame, e.kind, e.camera))
        pending = search = None  # [camera, begun, place, confirmed]; [begun, place, radius]
        for frame in range(min(e.frame for e in own), until + 1):
            if pending and frame - pending[1] > 135:
                out.append((gid, frame, "failed", None, None, (frame - pending[1]) / 30))
                pending = None
            if search and (frame - search[0]) / 30 > 1.5:
                out.append((gid, frame, "exhausted", None, None, (frame - search[0]) / 30))
                search = None
            for e in (e for e in own if e.frame == frame):
                if pending:
                    pending[2] = (e.x, e.y)
                if e.kind == "leave" and not pending:
                    fit = e.seconds <= 1.5 and e.score > 0
                    pending = [e.camera, frame, (e.x, e.y), 0] if fit else None
                    out.append((gid, frame, "triggered" if fit else "no receiver", e.camera, None, None))
                elif e.kind == "see":
                    unlike = e.alike is not None and e.alike < 0.55
                    if pending and e.camera == pending[0]:
                        pending[3] = 0 if unlike else pending[3] + 1
                        what = "disagreed" if unlike else "completed" if pending[3] == 3 else "confirming"
                        out.append((gid, frame, what, e.camera, None, (frame - pending[1]) / 30 if what == "completed" else None))
                        pending = None if what == "completed" else pending
                    if search and not unlike and ((e.x - search[1][0]) ** 2 + (e.y - search[1][1]) ** 2) ** 0.5 <= max(8.0, search[2] or 0.0):
                        out.append((gid, frame, "recovered", e.camera, None, (frame - search[0]) / 30))
                        search = None
                elif e.kind == "miss":
                    if not search and e.missed >= 4 and e.state != "tentative":
                        search = [frame, (e.x, e.y), None]
                        out.append((gid, frame, "recovery began", e.camera, None, None))
                    if search and not e.cameras:
                        out.append((gid, frame, "nobody sees", None, 0.0, None))
                    elif search:
                        radius = min(max(e.uncertainty, 8.0), 60.0)
                        search[2] = radius if search[2] is None else min(radius * 1.6, 60.0)
                        out.append((gid, frame, "searched", e.cameras[0], search[2], None))
    return sorted(out, key=repr)


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_over_events(spark):
    sf = "/root/testdata/sf0.001"
    events = c.coordination_events(spark, sf).collect()
    log = c.coordination_log(spark, sf).collect()
    assert {"triggered", "recovery began", "searched", "recovered"} <= {r.what for r in log}
    assert rounded(log) == rounded(plain(events, max(e.frame for e in events)))
    s = {r.what: r for r in c.coordination_summary(spark, sf).collect()}
    assert sum(r.times for r in s.values()) == len(log)
    took = [r.elapsed_s for r in log if r.what == "recovered"]
    assert s["recovered"].mean_elapsed_s == round(sum(took) / len(took), 6) and s["searched"].mean_elapsed_s is None
    assert c.coordinate(c.coordination_events(spark, sf).limit(0)).count() == 0


SCHEMA = "gid long, frame long, kind string, camera long, x double, y double, alike double, seconds double, score double, missed long, state string, uncertainty double, cameras array<long>"


def test_silence_is_noticed(spark):
    """A hand-over and a recovery that nothing follows end by the clock, in batch as in a stream that other identities move on."""
    ask = lambda gid, frame, kind: (gid, frame, kind, 1, 0.0, 0.0, None, 0.1, 1.0, 9, "confirmed", 5.0, [4, 5])
    rows = [ask(1, 0, "leave"), ask(1, 10, "miss"), ask(2, 0, "see"), ask(2, 200, "see"), ask(None, 3, "see"), ask(3, None, "see")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(1, 0, "triggered", 1, None, None), (1, 10, "recovery began", 1, None, None), (1, 10, "searched", 4, 8.0, None), (1, 56, "exhausted", None, None, 46 / 30), (1, 136, "failed", None, None, 136 / 30)]
    assert rounded(c.coordinate(df, until=200).collect()) == rounded(want)
    assert rounded(c.coordinate(df, until=135).collect()) == rounded(want[:-1])
    assert rounded(c.coordinate(df).collect()) == rounded(want[:3])


def test_batch_and_stream_agree(spark):
    sf = "/root/testdata/sf0.001"
    assert rounded(c.stream_coordination(spark, sf).collect()) == rounded(c.coordination_log(spark, sf).collect())
