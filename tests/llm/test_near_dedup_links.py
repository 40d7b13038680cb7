"""Links of buckets whose least id resembles none of the others."""

import pytest

from veilspark.llm import near_dedup


@pytest.mark.parametrize("block", [512, 2])
def test_a_third_text_does_not_part_a_pair(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "POOL", block)
    own = lambda n: [1000 * n + k for k in range(near_dedup.SAMPLES)]
    third = [1, 1, 1, *own(1)[3:]]
    pairs = []
    for n in range(2, 8):  # a pair agrees in the common band and two samples of each other band
        x = [1, 1, 1, *own(n)[3:]]
        pairs += [x, [v if k < 3 or k % 3 else -v for k, v in enumerate(x)]]
    rows = [("00", third)] + [(f"{n + 10}", s) for n, s in enumerate(pairs)] + [("90", third), ("91", own(9))]
    got = near_dedup.candidate_links(spark.createDataFrame(rows, "id string, samples array<int>")).collect()
    assert {tuple(sorted(r)) for r in got} == {("00", "90")} | {(f"{n}", f"{n + 1}") for n in range(10, 22, 2)}
