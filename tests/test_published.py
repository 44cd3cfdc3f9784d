"""Dispersions, tests and means against published results of a run over two groups of ten samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.functions import nbglm
from junctura.operators import testing

# Of three skipped exons the counts of the reported form and of the gene in 20 samples
# (the first ten are group A), the size factors of both, and what was published for them.
COUNTS = {
    "exon_skip.1": (
        [29, 83, 75, 50, 96, 33, 39, 61, 18, 34, 8, 15, 3, 15, 3, 7, 3, 11, 13, 3],
        [284, 724, 644, 496, 826, 392, 336, 516, 182, 328, 500, 398, 76, 432, 58, 222, 148, 506, 276, 160],
    ),
    "exon_skip.9": (
        [72, 89, 201, 155, 174, 108, 87, 104, 35, 51, 46, 76, 13, 77, 7, 59, 41, 113, 80, 11],
        [607, 568, 1010, 865, 1480, 967, 530, 653, 224, 346, 436, 856, 94, 502, 64, 541, 218, 667, 811, 178],
    ),
    "exon_skip.8": (
        [28, 54, 98, 39, 85, 67, 43, 38, 18, 16, 38, 71, 12, 57, 5, 38, 8, 102, 46, 14],
        [294, 515, 813, 422, 655, 627, 404, 348, 166, 216, 462, 610, 86, 589, 76, 336, 140, 703, 374, 162],
    ),
}
EVENT_FACTORS = [
    1.0127619866436404, 1.5001086253906517, 2.779579078550085, 1.8260761950029247, 2.4079711961464474, 1.9166404966835082, 1.1343455940226228, 1.3586918820642195, 0.5130589223300785, 0.8275506847657644,
    1.1422299092404686, 1.2043720076731015, 0.24436769290672394, 1.4457335439926502, 0.19098356114160264, 0.915436028866853, 0.5079960229998901, 2.0419679274315476, 1.303662796174951, 0.42652992089050357,
]
GENE_FACTORS = [
    0.9315285235101375, 1.6379678345444049, 2.343593271352112, 1.8305208202253764, 2.2348304822244742, 1.8461422549502273, 0.9199954514291557, 1.847766823069065, 0.4607363245590592, 0.7669808738238575,
    1.4252626245385631, 1.3901780518260087, 0.24665731494608906, 1.3422607502228323, 0.21663600921397153, 0.8653478018964678, 0.4335278726668714, 1.9832139600338041, 1.2695297812753554, 0.4972508730470608,
]
# p, raw and adjusted dispersion, mean counts of A and B and their log2 fold change, the same of expression
PUBLISHED = {
    "exon_skip.1": (4.811778753222029e-10, 0.04665373135073122, 0.060873052056879845, 35.08586895323417, 9.376311915134902, 1.9037976245357355, 334.17227652090423, 292.7045199476639, 0.1911470259838186),
    "exon_skip.9": (0.40524286369930895, 0.05061138708334276, 0.06377010841270582, 69.93112545739696, 53.413988503256235, 0.3887171073454452, 495.4718317969663, 443.33183211071554, 0.16041608609064717),
    "exon_skip.8": (0.6202054655705606, 0.03530883914728378, 0.06024818709435116, 31.080863978941757, 38.225154632724674, -0.2984957297324611, 310.9561822575305, 358.73149396980085, -0.2061931084887263),
}
IN_A = np.array([1.0] * 10 + [0.0] * 10)


@pytest.mark.parametrize("event", COUNTS)
def test_dispersion_and_test(event):
    y, sf = np.array([*COUNTS[event][0], *COUNTS[event][1]], float), np.array([*EVENT_FACTORS, *GENE_FACTORS])
    p, raw, adjusted = PUBLISHED[event][:3]
    found, ok = nbglm.raw_dispersion(y, sf, nbglm.design(IN_A), 10)
    assert ok and found == pytest.approx(raw, abs=1e-6)
    assert nbglm.ratio_test(y, sf, IN_A, adjusted, 0.5) == pytest.approx(p, abs=1e-6, rel=1e-6)
    # the run's trend, known to four digits, and its prior
    near, ok = nbglm.adjusted_dispersion(y, sf, nbglm.design(IN_A), found, -1.4439 / (y / sf).mean() + 0.0711, 0.1)
    assert ok and near == pytest.approx(adjusted, rel=1e-3)


def test_bounded_search():
    import math
    import random

    rng = random.Random(1)
    for _ in range(300):
        top, k = rng.uniform(1e-4, 9.99), rng.choice([1, 2, 3])
        f = {1: lambda x: -abs(x - top), 2: lambda x: -((math.log(x) - math.log(top)) ** 2), 3: lambda x: -math.cosh(x - top)}[k]
        calls = []
        x, ok = nbglm.bounded_max(lambda v: calls.append(v) or f(v))
        assert ok and abs(x - top) <= 1e-5 and 0 < min(calls) and max(calls) < 10 and len(calls) < 80
    assert nbglm.bounded_max(lambda x: x)[0] > 9.9999 and nbglm.bounded_max(lambda x: -x)[0] < 1e-4


def test_response_and_means(spark):
    names = [f"s{i:02d}" for i in range(20)]
    events = spark.createDataFrame([(e, e, 0, s, float(n)) for e, (own, _) in COUNTS.items() for s, n in zip(names, own)], "event_id string, gene_id string, form int, sample_id string, n double")
    genes = spark.createDataFrame([(e, s, n - 0.5) for e, (_, own) in COUNTS.items() for s, n in zip(names, own)], "gene_id string, sample_id string, raw_count double")
    factors = lambda values: spark.createDataFrame(list(zip(names, values)), "sample_id string, sf double")
    groups = spark.createDataFrame([(s, i < 10) for i, s in enumerate(names)], "sample_id string, in_a boolean")
    rows = testing.response(events, genes, factors(EVENT_FACTORS), factors(GENE_FACTORS), groups)
    for r in rows.collect():
        assert r.y == [*map(float, COUNTS[r.event_id][0]), *map(float, COUNTS[r.event_id][1])] and r.sf == [*EVENT_FACTORS, *GENE_FACTORS] and r.in_a == IN_A.tolist()
    columns = ["mean_event_count_A", "mean_event_count_B", "log2FC_event_count", "mean_gene_exp_A", "mean_gene_exp_B", "log2FC_gene_exp"]
    got = testing.means(rows.where(F.col("form") == 0)).collect()
    assert len(got) == 3
    for r in got:
        assert [r[c] for c in columns] == pytest.approx(list(PUBLISHED[r.event_id][3:]), abs=1e-6)
