"""Operator 9: gradients against differences, and accuracy on held-out texts."""

import numpy as np
import pyarrow as pa

from quern.llm import toxicity as T


def test_gradients():
    net = T.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    made = T.features(pa.array(["alpha", "be", "c", ""], pa.large_string()))
    at = np.array([[0, 1, 2, -1], [3, 0, 1, 2]])
    y = np.array([1.0, 0.0])

    def loss():
        s = net.forward(net.project(net.embed(made).astype(np.float64)), at)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = net.gradients(net.embed(made).astype(np.float64), made, at, y)
    assert len(net.p) == 12
    for k in net.p:
        flat = net.p[k].reshape(-1)
        i = int(np.argmax(np.abs(g[k]).reshape(-1)))
        old = flat[i]
        flat[i] = old + 1e-3
        up = loss()
        flat[i] = old - 1e-3
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 1e-3 + 0.05 * abs(g[k].reshape(-1)[i]), k


def test_windows_overlap_and_cover():
    off = np.array([0, 0, 5, 5 + 100])
    row, start, length = T.windows(off)
    assert row.tolist()[:2] == [0, 1] and length[0] == 0 and length[1] == 5
    seen = np.zeros(105, int)
    for s, n in zip(start[2:], length[2:]):
        seen[s : s + n] += 1
    assert (seen[5:] >= 1).all() and (seen[21:89] >= 2).all()


def test_held_out_accuracy(spark, table, rng):
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for d in range(900):
        w = rng.choices(vocab, k=rng.randint(5, 120))
        if bad := d % 3 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), "zyx" + "".join(rng.choices("klmn", k=3)))
        docs.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    docs += [(5000, None), (5001, ""), (None, "zyxkkk and words"), (5002, "w " * 30000), (7, docs[7][1])]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    frame = table(docs)
    net = T.fit(frame, lab)
    got = {r["doc_id"]: r["score"] for r in T.score(frame, net).collect()}
    import zlib

    held = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([(got[d] >= 0.7) == (d % 3 == 0) for d in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[5001] < 0.7
    assert T.score(table([]), net).count() == 0 and T.fit(frame, lab.where("toxic = 0")) is None
    assert {r["score"] for r in T.score(table([(1, "x")]), None).collect()} == {0.0}
