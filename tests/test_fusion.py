"""The filter against matrix algebra; fusion on scenes whose outcome is known, and on the adapter's objects."""

import numpy as np
import pytest

from skyledger.operators import fusion
from skyledger.sources import views


def test_filter_equals_matrices():
    p = fusion.FusionParams()
    f = fusion.Filter((3.0, 4.0), p)
    x, cov = np.array([3.0, 4, 0, 0]), np.diag([25.0, 25, 4, 4])
    h, r = np.eye(2, 4), np.eye(2) * p.measurement**2
    tick = 1 / 60
    q = np.kron(np.array([[tick**4 / 4, tick**3 / 2], [tick**3 / 2, tick**2]]), np.eye(2)) * p.process**2
    rng = np.random.default_rng(1)
    for i in range(40):
        dt = [1 / 30, 0.1][i % 2]
        m = np.eye(4) + dt * np.eye(4, k=2)
        x, cov = m @ x, m @ cov @ m.T + q * dt * 30
        f.predict(dt)
        if i % 3:
            z = rng.normal(size=2) * 5
            gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + r)
            a = np.eye(4) - gain @ h
            x, cov = x + gain @ (z - h @ x), a @ cov @ a.T + gain @ r @ gain.T
            f.update(z)
        assert np.allclose([*f.at, *f.velocity], x) and np.allclose([f.p, f.c, f.v], [cov[0, 0], cov[0, 2], cov[2, 2]])
    assert f.radius() == pytest.approx(3 * np.sqrt((cov[0, 0] + cov[1, 1]) / 2))
    assert f.time_to_radius(0.1) == 0 and f.time_to_radius(1000) > 0 and fusion.Filter((0, 0), p).time_to_radius(1000) == np.inf


def test_two_cameras_one_identity():
    s = fusion.Fusion()
    assert [x[:2] for x in s.step(0, [(1, "a", (0, 0), None), (2, "b", (0.5, 0), None)])] == [(1, "created"), (2, "created")]
    s = fusion.Fusion()
    s.step(0, [(1, "a", (0, 0), None)])
    assert s.step(1, [(1, "a", (0.1, 0), None), (2, "b", (0.2, 0), None)]) == [(1, "matched", False), (1, "matched", True)]
    assert s.all[1].handoffs == 1 and s.all[1].cameras == {1, 2}
    # one camera, two drones: an identity takes one of them
    assert [x[0] for x in s.step(2, [(1, "a", (0.1, 0), None), (1, "a", (2.0, 0), None)])] == [1, 2]


def test_gates():
    s = fusion.Fusion()
    s.step(0, [(1, "a", (0, 0), [1, 0])])
    # the wider gate is 1, so it takes even what the first pass refuses outright, within 40 m
    assert s.step(1, [(2, "a", (1, 0), [0, 1])])[0][:2] == (1, "rescued")
    s = fusion.Fusion(fusion.FusionParams(rescue_times=1.2))
    s.step(0, [(1, "a", (0, 0), [1, 0])])
    assert s.step(1, [(2, "a", (1, 0), [0, 1])])[0][1] == "created"
    s = fusion.Fusion()
    s.step(0, [(1, "a", (0, 0), None)])
    assert s.step(1, [(1, "a", (30, 0), None)])[0][:2] == (1, "rescued")
    s = fusion.Fusion()
    s.step(0, [(1, "a", (0, 0), None)])
    assert s.step(1, [(1, "a", (41, 0), None)])[0][1] == "created"
    s.step(20, [])
    assert not s.all
    assert fusion.FusionParams.of_rules(1).max_missed == 4 and fusion.FusionParams.of_rules(6).max_missed == 18


def test_adapter_objects_are_kept_apart(spark):
    sf = "/root/testdata/sf0.001"
    d = views.ground_sightings(spark, sf)
    got = fusion.fuse(d)
    assert got.count() == d.where("x is not null").count()
    mixed = got.join(d.select("site", "observation", "object"), ["site", "observation"]).groupBy("site", "global_id").agg({"object": "count"})
    assert mixed.count() < got.count()
    assert fusion.fuse(d.limit(0)).count() == 0


def plain_site(rows, p):
    """A site's observations joined one by one, with a filter per identity and every pair looked at."""
    alive, number, last, out = {}, 1, None, []
    for frame in sorted({r.frame for r in rows}):
        seen = sorted((r for r in rows if r.frame == frame), key=lambda r: r.observation)
        gap = 1 if last is None else frame - last
        if gap > p.max_missed + 1:
            alive, gap = {}, 1
        for i in alive.values():
            for _ in range(gap):
                i["f"].predict()
            if i["f"].radius() > p.max_radius_m:
                i["state"] = "lost"
        pairs = []
        for k, r in enumerate(seen):
            for n, i in alive.items():
                off = float(np.hypot(r.x - i["f"].at[0], r.y - i["f"].at[1]))
                cost = min(1.0, off / (3 * max(i["f"].radius(), 1.0)))
                if off > p.apart_m:
                    cost = 1.0
                elif r.camera not in i["cameras"]:
                    best = max([0.0, *(float(np.dot(g, r.embedding) / (np.linalg.norm(g) * np.linalg.norm(r.embedding))) for g in i["gallery"])])
                    cost = 1.0 if best < p.reid else min(1.0, p.motion * cost + p.appearance * min(1.0, max(0.0, (1 - best) / 2)))
                pairs.append((cost, k, n, off))
        of, taken = {}, set()
        for rescue, gate in ((False, p.gate), (True, min(1.0, p.gate * p.rescue_times))):
            for cost, k, n, off in sorted(pairs):
                if cost <= gate and k not in of and (n, seen[k].camera) not in taken and not (rescue and off > p.rescue_m):
                    of[k] = n, rescue
                    taken.add((n, seen[k].camera))
        how = {}
        for k in sorted(of, key=lambda k: of[k][1]):
            n, rescue = of[k]
            i, r = alive[n], seen[k]
            i["f"].update((r.x, r.y))
            how[k] = n, "rescued" if rescue else "matched", r.camera not in i["cameras"]
            i["handoffs"] += r.camera not in i["cameras"]
            i["hits"], i["last"], i["state"] = i["hits"] + 1, frame, "confirmed"
            i["cameras"].add(r.camera)
            i["gallery"] = [*i["gallery"], np.array(r.embedding)][-p.gallery :]
        for k, r in enumerate(seen):
            if k not in how:
                alive[number] = {"f": fusion.Filter((r.x, r.y), p), "cameras": {r.camera}, "gallery": [np.array(r.embedding)], "hits": 1, "handoffs": 0, "last": frame, "state": "tentative"}
                how[k] = number, "created", False
                number += 1
        for k, r in enumerate(seen):
            i = alive[how[k][0]]
            out.append((r.observation, *how[k], round(float(i["f"].at[0]), 6), round(float(i["f"].velocity[1]), 6), round(i["f"].radius(), 6), i["hits"], len(i["cameras"]), i["handoffs"], i["state"]))
        alive = {n: i for n, i in alive.items() if frame - i["last"] <= p.max_missed}
        last = frame
    return out


@pytest.mark.parametrize("how", [{}, {"gate": 0.2, "rescue_times": 1.5}, {"max_radius_m": 12.0, "max_missed": 2}])
def test_plain_loop(spark, how):
    """Row by row, on the adapter's sightings spread further apart, so that gates matter and more identities live."""
    p = fusion.FusionParams(**how)
    d = views.ground_sightings(spark, "/root/testdata/sf0.001").selectExpr("site", "frame + if(frame > 9, 20, 0) as frame", "observation", "camera", "node", "x * 0.8 + observation % 5 * 9 as x", "y * 0.8 + observation % 3 * 11 as y", "embedding")
    got = {}
    for r in fusion.fuse(d, p).collect():
        got.setdefault(r.site, []).append((r.observation, r.global_id, r.how, r.new_camera, round(r.x, 6), round(r.vy, 6), round(r.radius_m, 6), r.hits, r.cameras, r.handoffs, r.state))
    rows = d.where("x is not null").collect()
    assert len(got) == len({r.site for r in rows})
    for site, own in got.items():
        assert sorted(own) == sorted(plain_site([r for r in rows if r.site == site], p))
