"""The persona run on fitted clusters against plain forms of its parts."""

import statistics
from collections import Counter, defaultdict

import pytest
from wayfare.functions.durable import materialize
from wayfare.operators import personas, segments
from wayfare.plans import persona_queries
from wayfare.sources.fixtures import Tables


@pytest.fixture(scope="module")
def run(spark, data):
    rows = materialize(persona_queries.features(Tables(spark, f"{data}/sf0.01")), "features")
    assigned = segments.assigned_clusters(rows)
    return rows, assigned, segments.segments(rows).collect(), {r["ad_id"]: r for r in rows.collect()}, {r["ad_id"]: r for r in assigned.collect()}


def test_clusters_are_whole(run):
    _, _, out, devices, assigned = run
    assert set(assigned) == set(devices)
    sizes = Counter(r["cluster"] for r in assigned.values())
    assert {r["cluster"]: r["devices"] for r in out} == sizes and len(sizes) >= 2
    assert sum(r["percent_of_base"] for r in out) == pytest.approx(100)
    assert len({r["name"] for r in out}) == len(out)


def test_profiles_of_fitted_clusters(run):
    _, _, out, devices, assigned = run
    own = defaultdict(list)
    for k, r in assigned.items():
        own[r["cluster"]].append(devices[k])
    for r in out:
        rows = own[r["cluster"]]
        for m in personas.MEDIANS:
            assert r[f"median_{m}"] == pytest.approx(statistics.median(x[m] for x in rows))
        shares = {h: statistics.fmean(x[f"{h}_share"] for x in rows) for h in ("morning", "midday", "afternoon", "evening", "night")}
        assert shares[r["peak_hour"]] == pytest.approx(max(shares.values()))
        zips = Counter(x["home_zip"] for x in rows if x["home_zip"])
        assert [(x["value"], x["n"]) for x in r["top_zips"]] == sorted(zips.items(), key=lambda x: (-x[1], x[0]))[:5]
        near = sorted((assigned[x["ad_id"]]["distance"], x["ad_id"]) for x in rows)[:5]
        assert list(r["examples"]) == [k for _, k in near]


def test_lookalikes_of_fitted_clusters(run):
    rows, assigned, out, devices, of = run
    profiles = personas.cluster_profiles(rows, assigned)
    found = defaultdict(set)
    for r in segments.lookalikes(rows, assigned, profiles).collect():
        found[r["cluster"], r["method"]].add(r["ad_id"])
        assert of[r["ad_id"]]["cluster"] != r["cluster"]
    for r in out:
        zips = {x["value"] for x in r["top_zips"]}
        assert found[r["cluster"], "zips"] == {k for k, d in devices.items() if d["home_zip"] in zips and of[k]["cluster"] != r["cluster"]}
        assert {m: r[f"lookalike_{m}"] for m in segments.METHODS} == {m: len(found[r["cluster"], m]) for m in segments.METHODS}


def test_no_devices(run):
    with pytest.raises(ValueError, match="no devices"):
        segments.segments(run[0].limit(0))
