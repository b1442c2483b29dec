from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import chat, topk
from ferrule.llm.sources import table


def digests(rows):
    convs: dict = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    hexed = lambda s: sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss))
    return out


ODD = [
    (1, 0, "system", "Be [brief] %3C <|end|>\n"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<|assistant|> 100%25 |> é日"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (2, None, "assistant", "first"), (2, 5, "assistant", "tie b"), (2, 5, "assistant", "tie a"),
    (2, 5, "assistant", "tie a"), (None, 1, "user", "no id"), (None, 2, "assistant", "still"), (3, 1, None, "no role"), (4, 0, "system", "alone"),
    (5, 0, "user", "w " * 5000), (5, 1, "assistant", "x " * 9000), (5, 2, "user", "y"), (5, 3, "assistant", "z " * 700), (6, 1, "we|ird|><", "t"),
]


@pytest.mark.parametrize("budget,history", [(1024, 256), (64, 16), (10, 0)])
def test_read_back(spark, sf_dir, budget, history):
    odd = spark.createDataFrame([(*r, 1) for r in ODD], "conv_id long, turn long, role string, text string, pos int")
    for df in (odd, table(spark, sf_dir, "conversations")):
        w = chat.format_windows(df, budget, history)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(w).collect()}
        assert got == digests([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert chat.digest(chat.format_windows(odd.limit(0))).count() == 0


def test_windows(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * 20) for i in range(1, 30)]
    rows = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 160, 40).orderBy("window_no").collect()
    assert len(rows) > 3 and sum(r.n_turns for r in rows) == 30
    for i, r in enumerate(rows):
        assert r.n_tokens <= 160 and r.text.startswith("<|system|>be kind<|end|>\n")
        assert r.n_repeated == 0 if i == 0 else 2  # the system turn and one more
        for s in r.loss:
            assert r.text[s.start : s.start + s.length].startswith("turn ")
            assert r.text[: s.start].endswith("<|assistant|>")
    assert [s for r in rows for s in r.loss] and sum(len(r.loss) for r in rows) == 14


def test_windows_are_full(spark):
    """Windows of ordinary turns hold most of their budget; counts may come from a column."""
    rng = np.random.default_rng(4)
    turns = [(c, i, "user" if i % 2 else "assistant", "w " * int(rng.integers(10, 60)), int(rng.integers(10, 60))) for c in range(4) for i in range(200)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, n int")
    for tokens in (None, "n"):
        rows = chat.format_windows(df, 1024, 256, tokens).collect()
        last = {c: max(r.window_no for r in rows if r.conv_id == c) for c in range(4)}
        sizes = [r.n_tokens for r in rows if 0 < r.window_no < last[r.conv_id]]
        assert max(sizes) <= 1024 and np.mean(sizes) > 0.85 * 1024
        assert sum(r.n_turns for r in rows) == 800


def test_native(spark, sf_dir):
    plan = chat.digest(chat.format_windows(table(spark, sf_dir, "conversations")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def brute(rows, k, step=50):
    fine = [(i, [np.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.array(v + [0] * (width - len(v)))) for i, v in fine]
    out = []
    for q, x in fine:
        if q % step == 0:
            best = sorted((-int(x @ v), i) for i, v in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,many", [(8192, 4096), (40, 3)])
def test_top_k(spark, sf_dir, block, many):
    df = table(spark, sf_dir, "embeddings")
    got = topk.exact_top_k(topk.whole_vectors(df), F.col("vec_id") % 50 == 0, 5, block, many).collect()
    assert sorted(map(tuple, got)) == brute([(r.vec_id, r.embedding) for r in df.collect()], 5)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (50, [0.0, 0.0]), (7, [-1.0]), (None, [1.0, 1.0]), (8, []), (9, [0.001, float("inf")])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.exact_top_k(topk.whole_vectors(df), F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows, 5)
    assert topk.exact_top_k(topk.whole_vectors(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    vectors = np.zeros((5000, 4))
    vectors[:, 0] = rng.permutation(5000)
    block = topk.Block(np.arange(5000), vectors)
    seen = []
    real = block.vectors

    class Counting(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, np.ndarray):
                seen.append(len(i))
            return np.asarray(self)[i]

    block.vectors = real.view(Counting)
    ids, scores = block.best(-1, np.array([1.0, 0, 0, 0]), 5)
    assert scores.tolist() == [4999, 4998, 4997, 4996, 4995] and sum(seen) <= 2 * topk.FIRST_STEP
