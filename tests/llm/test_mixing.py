from collections import Counter

import pytest

from kinfold.llm import mixing


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, s, " ".join(["word"] * (5 + i % 40)), "x") for s, n, at in (("big", 600, 0), ("mid", 200, 10_000), ("small", 40, 20_000)) for i in range(at, at + n)]
    rows += [(90_000, "big", None, "x"), (90_001, "big", "", "x"), (90_002, None, "word", "x"), (90_003, "other", "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, plan string")
    targets = spark.createDataFrame(
        [("a", "big", 0.5, 1), ("a", "mid", 0.3, 2), ("a", "small", 0.2, 4), ("b", "small", 0.9, 3), ("b", "big", 0.1, 1), ("b", "gone", 0.5, 1), ("b", "gone", 0.5, 1), ("c", "gone", 1.0, 1)],
        "plan string, source string, target_share double, max_repeats int",
    )
    return targets, mixing.mix(docs, targets, block_tokens=64)


def test_shares_and_repeats(mixed):
    targets, m = mixed
    rows = m.collect()
    uses = Counter((r.plan, r.doc_id) for r in rows)
    source = {(r.plan, r.doc_id): r.source for r in rows}
    most = {("a", "big"): 1, ("a", "mid"): 2, ("a", "small"): 4, ("b", "small"): 3, ("b", "big"): 1}
    assert all(n <= most[k[0], source[k]] for k, n in uses.items())
    total = Counter()
    for r in rows:
        total[r.plan, r.source] += r.n_tokens
    whole = total["a", "big"] + total["a", "mid"] + total["a", "small"]
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(total["a", s] / whole - share) < 0.03
    # the schedule ends where a source is used up
    assert max(uses[k] for k in uses if source[k] == "small" and k[0] == "a") == 4
    b = total["b", "small"] + total["b", "big"]
    assert abs(total["b", "small"] / b - 0.9) < 0.05
    assert len({(r.plan, r.doc_id, r.use_no) for r in rows}) == len(rows)


def test_every_stretch_has_the_shares(mixed):
    _, m = mixed
    slots = sorted({(r.slot, r.source) for r in m.collect() if r.plan == "a"})
    half = slots[: len(slots) // 2]
    assert abs(sum(s == "big" for _, s in half) / len(half) - 0.5) < 0.1


def test_report(mixed):
    targets, m = mixed
    got = {(r.plan, r.source): r for r in mixing.shares(m, targets).collect()}
    assert len(got) == 7 and got["b", "gone"].actual_share == 0 and got["c", "gone"].tokens == 0
    assert abs(sum(r.actual_share for (p, _), r in got.items() if p == "a") - 1) < 1e-9
    assert got["a", "small"].max_uses == 4


def test_empty(spark, mixed):
    targets, _ = mixed
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs, targets).collect() == []


def test_planned_sources_are_found_among_any_number(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PLANNED", 3)
    docs = spark.createDataFrame([(i, f"s{i:02}", "word word") for i in range(40)], "doc_id long, source string, text string")
    for s in ("s00", "s17", "s39"):
        targets = spark.createDataFrame([("a", s, 1.0, 1), ("a", "gone", 0.5, 1)], "plan string, source string, target_share double, max_repeats int")
        assert [r.source for r in mixing.mix(docs, targets).collect()] == [s]
    with pytest.raises(ValueError):
        mixing.mix(docs, docs.limit(4).selectExpr("'a' as plan", "source", "0.25D as target_share", "1 as max_repeats"))
