"""Property tests (hypothesis): metrics against brute force on random
predictions, including ties, one-class and tiny inputs."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pixelmill.operators import metrics as E

rows = st.lists(st.tuples(st.integers(0, 1), st.integers(-3, 3), st.integers(0, 1)), min_size=1, max_size=40)


def _brute(data):
    y = np.array([r[0] for r in data])
    s = np.array([float(r[1]) for r in data])
    p = np.array([float(r[2]) for r in data])
    pos, neg = s[y == 1], s[y == 0]
    auc = None
    if len(pos) and len(neg):
        auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    n = len(y)
    prec = rec = f1 = 0.0
    for c in (0, 1):
        support = (y == c).sum()
        if support == 0:
            continue
        tp = ((y == c) & (p == c)).sum()
        pr = tp / (p == c).sum() if (p == c).sum() else 0.0
        rc = tp / support
        ff = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        prec += pr * support / n
        rec += rc * support / n
        f1 += ff * support / n
    return auc, (y == p).mean(), prec, rec, f1


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows)
def test_metrics_match_brute_force(spark, data):
    df = spark.createDataFrame([(i, a, float(b), float(c)) for i, (a, b, c) in enumerate(data)],
                               "id long, label int, score double, prediction double")
    m = E.evaluate(df).collect()[0]
    auc, acc, prec, rec, f1 = _brute(data)
    assert (m["auc_roc"] is None) if auc is None else abs(m["auc_roc"] - auc) < 1e-12
    assert abs(m["accuracy"] - acc) < 1e-12
    assert abs(m["precision"] - prec) < 1e-12
    assert abs(m["recall"] - rec) < 1e-12
    assert abs(m["f1_score"] - f1) < 1e-12
