"""Vector search, quality, chat formatting, WARC, packing and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import chat_format, exact_dedup, packing, quality, secrets, vector_search, warc
from quadrille.llm.registry import ORACLES, QUERIES, table
from tests.llm.helpers import CLASHING, awkward, empty
from tests.llm.test_text_operators import least_similar, normal, redacted


# -- vector search -------------------------------------------------------------------------------------------------
def exact_neighbours(ids, x, q, k):
    s = x @ x[list(ids).index(q)]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [int(ids[i]) for i in order]


def test_recall_and_scores(spark, sf):
    rows = table(spark, sf, "embeddings").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float64)
    got = QUERIES["op2_additive_quantisation"](spark, sf).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, x[g.vec_id] @ x[q], rtol=0, atol=1e-12)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        hits += len(set(g.vec_id) & set(exact_neighbours(ids, x, q, 20)))
    assert got.query_id.nunique() == sum(ids % 20 == 0) and hits / len(got) >= 0.9


def test_many_equal_vectors_keep_smallest_ids(spark):
    r = np.random.default_rng(1)
    hot = r.standard_normal(8)
    rows = [(i, [float(v) for v in (hot if i % 3 == 0 else r.standard_normal(8))]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search(df, df.where("vec_id in (0, 300)"), k=5).toPandas()
    ids, x = np.arange(600), np.array([v for _, v in rows])
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank").vec_id.tolist() == exact_neighbours(ids, x, q, 5)


@pytest.mark.parametrize("spread", [0.0, 1e-3])
def test_a_repeated_id_takes_one_place(spark, spread):
    """Id 7 thirty times, with equal or with different vectors, beside thirty others with the same or a near vector."""
    r = np.random.default_rng(3)
    hot = r.standard_normal(8)
    rows = [(7, hot * (1 + spread * i)) for i in range(30)] + [(100 + i, hot) for i in range(30)] + [(200 + i, hot + r.standard_normal(8) * 0.01) for i in range(30)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").coalesce(1)
    score = defaultdict(lambda: -math.inf)
    for i, v in rows:
        score[i] = max(score[i], (v * hot).sum())
    del score[100]
    want = sorted(score, key=lambda i: (-score[i], i))[:20]
    got = vector_search.search(df, df.where("vec_id = 100"), k=20).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == want and np.allclose(got.score, [score[i] for i in want])


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("codes", "norm", "rank", "vector")})
    got = vector_search.search(df, df, k=20).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(a, b) for a in (0, 1, 7) for b in (0, 1, 7) if a != b}
    assert vector_search.search(df.limit(0), df, k=3).count() == 0 and vector_search.search(df, df.limit(0), k=3).count() == 0


def test_repeated_rows_leave_room_for_others(spark):
    rows = [(1, [1.0, 0.0])] * 10 + [(2, [0.9, 0.1]), (3, [0.9, 0.1]), (9, [0.5, 0.5]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search(df, df.where("vec_id = 0"), k=4).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 9]


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_where_few_rows_are_ranked_again(spark, seed):
    """20,000 vectors in clusters, and 2,000 near-equal ones; few of all products are exact, however rows are batched."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((200, 32))
    x = centres[r.integers(0, 200, 20_000)] + 0.5 * r.standard_normal((20_000, 32))
    x[:2000] = centres[0] + 1e-3 * r.standard_normal((2000, 32))
    rows = spark.createDataFrame(__import__("pandas").DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    asked = rows.where("vec_id % 100 = 0")
    got = vector_search.search(rows, asked, k=20).toPandas()
    ids = np.arange(len(x))
    hits = sum(len(set(g.vec_id) & set(exact_neighbours(ids, x, q, 20))) for q, g in got.groupby("query_id"))
    assert len(got) == 200 * 20 and hits / len(got) >= 0.97
    hot = got[got.query_id < 2000]
    assert sum(len(set(g.vec_id) & set(exact_neighbours(ids, x, q, 20))) for q, g in hot.groupby("query_id")) / len(hot) >= 0.97
    exact = vector_search.search(rows, asked, k=20, counted=True).first()["exact"]
    cold = vector_search.search(rows, asked.where("vec_id >= 2000"), k=20, counted=True).first()["exact"]
    assert cold < 0.05 * 180 * len(x) and exact < 0.05 * 200 * len(x) + 20 * 2000


def test_bounds_do_not_depend_on_batches():
    r = np.random.default_rng(4)
    x, q = r.standard_normal((900, 16)), r.standard_normal((7, 16))
    norm = np.linalg.norm(x, axis=1)
    books = vector_search.Codebooks.fit(x / norm[:, None], books=4, words=16)
    codes, left = books.encode((x / norm[:, None]).astype(np.float32))
    assert np.allclose(x / norm[:, None] - left, sum(books.words[b][codes[:, b]] for b in range(4)), atol=1e-5)
    rest = (norm * np.linalg.norm(left, axis=1)).astype(np.float32)
    found = []
    for cut in (900, 300, 100):
        merged = [[] for _ in q]
        for i in range(0, 900, cut):
            part = slice(i, i + cut)
            rows = vector_search.Rows(np.arange(900)[part], x[part], norm[part].astype(np.float32), rest[part], codes[part])
            col, at, score, _ = rows.near(books, np.full(7, -1), q, np.full(7, -np.inf), 5, 6.0)
            for c, a, s in zip(col, at, score, strict=True):
                merged[c].append((-s, a))
        found.append([[a for _, a in sorted(m)[:5]] for m in merged])
    assert found[0] == found[1] == found[2] == [list(np.argsort(-(x @ v))[:5]) for v in q]


def test_beam_search_beats_greedy():
    r = np.random.default_rng(2)
    x = r.standard_normal((500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = vector_search.Codebooks.fit(x, books=4, words=16)

    def error(beam):
        codes, left = books.encode(x, beam)
        error = ((x - sum(books.words[b][codes[:, b]] for b in range(4))) ** 2).sum()
        assert error == pytest.approx((left**2).sum(), rel=1e-3)
        return error

    assert error(8) <= error(1) < (x**2).sum()
    lut = books.tables(x[:3])
    codes, _ = books.encode(x)
    assert np.allclose(sum(lut[:, b][:, codes[:, b]] for b in range(4)), x[:3] @ sum(books.words[b][codes[:, b]] for b in range(4)).T, atol=1e-4)


# -- quality -------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality_classifier"](spark, sf).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98


def test_gradient_of_the_model():
    r = np.random.default_rng(0)
    model = quality.Model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    bags = [r.random((n, quality.FEATURES)) * 0.1 for n in (1, 3, 2)]
    y, first, x = np.array([1.0, 0.0, 1.0]), np.array([0, 1, 4]), np.concatenate(bags)

    def loss():
        s = np.array([model.score(iter([b])) for b in bags])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = model._gradient(x, first, y)
    for k in model.p:
        at = tuple(0 for _ in model.p[k].shape)
        old, h = model.p[k][at], 1e-5
        model.p[k][at] = old + h
        up = loss()
        model.p[k][at] = old - h
        assert abs((up - loss()) / (2 * h) - grad[k][at]) < 1e-5, k
        model.p[k][at] = old


def test_slices_do_not_change_a_score(monkeypatch):
    model, text = quality.Model(), "some words, again and again. " * 3000
    whole = model.score(quality.slices(text))
    monkeypatch.setattr(quality, "SLICE", 7)
    assert abs(model.score(quality.slices(text)) - whole) < 1e-6


def plain_score(text, p):
    """Passages, features, gated attention and score of one text, value by value."""
    raw = (text or "").encode()
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\x0b\x0c", ".", ",;:", "'\"`()", "-_/\\", "!?", "|<>{}[]", "%&$*#@^~+="]
    kind = lambda b: next((i for i, k in enumerate(kinds) if chr(b) in k), len(kinds))
    words = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    starts = [w[0] for w in words[::50]] or [0]
    starts[0] = 0
    bag = []
    for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw)], strict=True)):
        single, pairs = [0.0] * 136, [0.0] * 169
        for i in range(a, b):
            single[raw[i] if raw[i] < 128 else 128 + (raw[i] - 128) // 16] += 1
            if i:
                pairs[kind(raw[i - 1]) * 13 + kind(raw[i])] += 1
        mine = words[50 * n : 50 * n + 50]
        same = [sum(i >= lag and words[i][1] == words[i - lag][1] for i in range(50 * n, 50 * n + len(mine))) / len(mine) if mine else 0.0 for lag in (1, 2, 3)]
        bag.append([math.sqrt(x / max(sum(single), 1)) for x in single] + [math.sqrt(x / max(sum(pairs), 1)) for x in pairs] + [math.sqrt(x) for x in same])
    product = lambda x, m: [sum(a * float(b) for a, b in zip(x, m[:, j], strict=True)) for j in range(m.shape[1])]
    hidden, energy = [], []
    for x in bag:
        h = [math.tanh(v + float(c)) for v, c in zip(product(x, p["W"]), p["b"], strict=True)]
        gate = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(product(h, p["V"]), product(h, p["U"]), strict=True)]
        hidden.append(h)
        energy.append(product(gate, p["w"])[0])
    weight = [math.exp(e) for e in energy]
    z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-product(z, p["c"])[0] - float(p["d"][0])))


def test_scores_equal_a_plain_forward_pass(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    extra = spark.createDataFrame([(-1, None, "", "", 0), (-2, "", "", "", 0), (-3, " \n", "", "", 0), (-4, "é😀 again again", "", "", 0)], docs.schema)
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.unionAll(extra).collect()}
    for r in quality.score(docs.unionAll(extra), labels).collect():
        assert r["score"] == pytest.approx(plain_score(texts[r["doc_id"]], model.p), abs=2e-4), texts[r["doc_id"]]
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_fit_takes_all_passages_and_each_id_once(spark, monkeypatch):
    """One labelled id under thousands of rows leaves the others their place, and no passage is left out."""
    seen = {}
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y, **_: seen.update(bags=bags, y=y) or self)
    ids = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5][:18]
    rows = [(i, f"text {i} " * 50 * (i + 1)) for i in ids] + [(ids[-1], f"text {n} and more") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"), sample_docs=18)
    assert len(seen["bags"]) == 18 and seen["y"].tolist() == [i % 2 for i in ids]
    assert [len(b) for b in seen["bags"]] == [2 * (i + 1) for i in ids[:-1]] + [1]


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.score(awkward(spark), labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    none = quality.score(awkward(spark), labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    kept = quality.keep_good(awkward(spark), labels.limit(0))
    assert kept.columns == awkward(spark).columns and kept.count() == 13
    assert quality.score(empty(spark), labels).count() == 0


# -- chat ----------------------------------------------------------------------------------------------------------
TRICKY = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "[\\/INST]\\", "<", "[", "</s", "<<s>[[INST]", "", "😀</s>", "a\nb", "\\</s>\\"]


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "x", "s", ">"]) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat_format.unescape(F.col("e"))).collect():
        assert r["back"] == r["t"] and not re.search(r"</?s>|\[/?INST\]", r["e"])


def test_chat_examples_and_digest(spark):
    rows = [(1, 1, "assistant", TRICKY[0]), (1, 0, "user", "hi"), (1, 3, "assistant", None), (1, 2, None, "x"), (1, 2, None, "x"), (2, 0, "user", "alone"), (None, None, "assistant", "lost"), (3, 0, "a [/INST] b", "t")]
    rows += [(4, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("rows", "loss", "__conv", "formatted", "examples")})
    got = {r["conv_id"]: r for r in chat_format.digest(df).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = chat_format.with_text(chat_format.conversations(df)).where("conv_id = 4").orderBy("example_no").collect()
    assert len(whole) == 5
    for r in whole:
        reply = re.sub(chat_format.ESCAPED, r"\1\2\3", r["text"][r["loss_start"] : r["loss_end"]])
        assert r["text"].startswith("<s>[INST] user [/INST]") and reply == TRICKY[2 * r["example_no"] + 1]
        assert r["context_chars"] == r["loss_start"] and len(r["text"]) == r["loss_end"]
    short = {(r["conv_id"], r["example_no"]): r for r in chat_format.examples(df).collect()}
    assert len(short) == sum(r == "assistant" for c in by for _, r, _ in by[c])
    for r in chat_format.with_text(chat_format.conversations(df)).collect():
        e = short[r["conv_id"], r["example_no"]]
        assert r["text"][r["loss_start"] :] == e["reply"] and all(r[c] == e[c] for c in ("target_turn", "turn_start", "context_chars", "loss_start", "loss_end"))
    assert chat_format.digest(df.limit(0)).count() == 0 and chat_format.examples(df.limit(0)).count() == 0


def test_chat_digest_reads_written_examples(spark, monkeypatch):
    """What the written contexts and replies say decides the digests."""
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "one"), ("assistant", "two"), ("user", "six"), ("assistant", "ten"), ("user", "end")])] + [(2, 0, "user", "one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    written = chat_format._written
    for old, new in (("", ""), ("one", "ONE"), ("ten", "TEN"), ("end", "END")):
        monkeypatch.setattr(chat_format, "_written", lambda end, old=old, new=new: F.replace(written(end), F.lit(old), F.lit(new)))
        for r in chat_format.digest(df).collect():
            said = [(role, t.replace(old, new)) for c, _, role, t in rows if c == r["conv_id"]]
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256("".join(t for role, t in said if role == "assistant").encode()).hexdigest() and r["n_turns"] == len(said)


def test_one_long_conversation(spark):
    """Thousands of turns in one conversation cost no more than as many in many."""
    df = spark.range(6000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, repeat(' é<s>', 40)) AS text")
    r = chat_format.digest(df).first()
    loss = "".join(f"turn {i}" + " é<s>" * 40 for i in range(1, 6000, 2))
    assert r["n_turns"] == 6000 and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_runs_no_python(spark, sf):
    plan = chat_format.digest(table(spark, sf, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- WARC ----------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    page = "<p>ünïcode 😀</p>" * 90
    rows = [(1, "http://a/", page), (2, "http://b/\r\nX: y", page), (3, None, page), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "n", page), (None, "m", "q" * 2000), (8, "v", "x" * 1_000_000), (9, "w", "edge\r\n\r\n" * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("digest", "d", "last", "file", "offset", "payload")})
    index = warc.write(df, f"file://{tmp_path}/archive", file_bytes=300)
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    for i, url, html in rows:
        if i is not None:
            raw = (html or "").encode()
            assert by[i]["payload_bytes"] == len(raw) and by[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
            assert (by[i]["payload"] is None) == (i in (1, 2)) and (i in (1, 2) or bytes(by[i]["payload"]) == raw)
            assert by[i]["refers_to"] == (3 if i in (1, 2) else None) and by[i]["record_type"] == ("revisit" if i in (1, 2) else "response")
    assert by[1]["url"] == "http://a/" and by[3]["url"] is None and "\n" not in by[2]["url"]
    some = warc.read(index.where("page_id in (3, 8)")).collect()
    assert {r["page_id"] for r in some} == {3, 8}
    assert warc.read(warc.write(df.limit(0))).count() == 0
    import gzip

    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archive").glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(rows)


def test_ranges_coalesce():
    assert warc.ranges([(0, 10), (10, 10), (25, 5), (100, 5)], gap=5, most=40) == [(0, 30, [0, 1, 2]), (100, 105, [3])]
    assert warc.ranges([(0, 10), (10, 100)], gap=5, most=40) == [(0, 10, [0]), (10, 110, [1])]
    assert warc.ranges([]) == []


# -- packing -------------------------------------------------------------------------------------------------------
def plain_fill(lengths, capacities, least):
    """Best fit by looking at every open bin; the youngest of equal bins is taken."""
    bins = []
    left = sum(lengths)
    for n in lengths:
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            room = min(b[0] - b[1] for b in fit)
            b = max((b for b in fit if b[0] - b[1] == room), key=lambda b: b[3])
        else:
            able = [c for c in capacities if c >= n]
            c = min(able, key=lambda c: (packing.cost(c) / min(c, left), -c)) if least is None else next((c for c in able if c >= least), able[-1])
            b = [c, 0, [], 0]
            bins.append(b)
        b[1] += n
        b[2].append(n)
        b[3] = max(x[3] for x in bins) + 1
        left -= n
    return sum(packing.cost(min(c for c in capacities if c >= b[1])) for b in bins)


@pytest.mark.parametrize("seed", range(12))
def test_packing_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    capacities = sorted(rng.sample(range(8, 60), rng.randint(1, 4)))
    lengths = [rng.randint(1, capacities[-1]) for _ in range(rng.randint(1, 60))]
    where, size, used = packing.pack_group(lengths, capacities)
    for b, (c, u) in enumerate(zip(size, used, strict=True)):
        assert u == sum(n for n, w in zip(lengths, where, strict=True) if w == b) and c == min(x for x in capacities if x >= u)
    falling = sorted(lengths, reverse=True)
    assert sum(map(packing.cost, size)) == pytest.approx(min(plain_fill(falling, capacities, least) for least in (None, *capacities)))


SMALL = (16, 32, 64)


def test_bins_decode_to_the_texts(spark):
    """Every token of every row is in a bin, once, and decoding the segments of a text gives it back."""
    rng = random.Random(2)
    words = ["alpha", "b", " ", "\n", "größe", "😀", "don't", "x1y2", "  ", "…"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randint(0, 150)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "long text " * 900), (None, "no id"), (1003, "twice"), (1003, "twice"), (1004, "q" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("bin", "segment", "pack_group", "token_ids", "lengths", "n")})
    tokens = packing.tokenizer()
    packed = packing.pack(df.coalesce(1), capacities=SMALL, group_items=100).persist()
    got = packing.segments(packed).toPandas()
    bins = packed.toPandas()
    assert got.pack_group.nunique() > 3 and len(bins[["pack_group", "bin"]].drop_duplicates()) == len(bins)
    for _, b in bins[bins.bin.notna()].iterrows():
        assert len(b.token_ids) == b.n_tokens == sum(b.lengths) and b.waste == b.bin_capacity - b.n_tokens >= 0
        assert b.bin_capacity == min(c for c in SMALL if c >= b.n_tokens)
    placed = got[got.n_tokens > 0]
    once = placed[placed.doc_id != 1003].sort_values("segment").groupby("doc_id", dropna=False).token_ids.apply(lambda parts: tokens.decode([t for p in parts for t in p]))
    want = {i: t for i, t in rows if t}
    assert {i: once[i] for i in want if i not in (None, 1003)} == {i: t for i, t in want.items() if i not in (None, 1003)}
    assert once[once.index.isna()].tolist() == ["no id"] and len(placed[placed.doc_id == 1003]) == 2
    assert set(got[got.n_tokens == 0].doc_id) == {i for i, t in rows if not t} and got[got.n_tokens == 0].bin.isna().all()
    cut = got[got.doc_id == 1002].sort_values("segment")
    assert cut.segment.tolist() == list(range(len(cut))) and cut.start.tolist() == [64 * i for i in range(len(cut))] and (cut.n_tokens[:-1] == 64).all()
    assert packing.pack(df.limit(0)).count() == 0


def test_packed_ids_are_the_tokenizers_and_bins_are_best_fits(spark, sf):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(packing.VOCABULARY, "rb"))}  # noqa: SIM115
    encode = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    packed = QUERIES["op10_best_fit_packing"](spark, sf).persist()
    got = defaultdict(list)
    for r in packing.segments(packed).orderBy("segment").collect():
        got[r["doc_id"]] += r["token_ids"]
    assert got == {i: encode(t) for i, t in texts.items()}
    for _, g in packed.where("bin is not null").toPandas().groupby("pack_group"):
        falling = sorted((n for b in g.lengths for n in b), reverse=True)
        assert sum(map(packing.cost, g.bin_capacity)) == pytest.approx(min(plain_fill(falling, packing.CAPACITIES, least) for least in (None, *packing.CAPACITIES)))


# -- pipeline and registry -----------------------------------------------------------------------------------------
def test_pipeline_equals_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels)
    rows = [r for r in docs.orderBy("doc_id").collect() if model.score(quality.slices(r["text"])) >= quality.THRESHOLD]
    seen, unique = set(), []
    for r in rows:
        if normal(r["text"]) not in seen:
            seen.add(normal(r["text"]))
            unique.append(r)
    least = least_similar({r["doc_id"]: r["text"] for r in unique})
    kept = {r["doc_id"]: redacted(r["text"]) for r in unique if r["doc_id"] == least[r["doc_id"]]}
    ids = defaultdict(list)
    for r in packing.segments(corpus_pipeline.run(spark, sf)).orderBy("segment").collect():
        ids[r["doc_id"]] += r["token_ids"]
    assert {i: packing.tokenizer().decode(x) for i, x in ids.items()} == kept
    assert 0 < len(kept) < docs.count() and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.dtypes == table(spark, sf, "documents").dtypes


def test_queries_equal_their_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(map(str, got.select(*names).collect())) == sorted(str(spark_row(names, r)) for r in want.fetchall()), name


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values, strict=True)))


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent / "quadrille"
    others = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert others and not any(re.search(r"\bllm\b", p.read_text()) for p in others)
    assert CLASHING and secrets.KINDS and exact_dedup.PREFIX_CHARS


def test_stages_on_awkward_and_empty_documents(spark, sf):
    """Each stage takes nulls in any column, repeated rows, clashing further columns and an empty table."""
    docs = awkward(spark).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("src0"), "n_chars": F.length("text").cast("long")})
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf)
            rows = now.count()
            assert name == "best-fit packing" or rows <= start.count() and now.columns == docs.columns, name
        assert (rows > 0) == (start is docs)


def test_bounded_sample(spark):
    from quadrille.llm.storage import bounded_sample

    df = spark.range(50_000)
    a, b = (sorted(r[0] for r in bounded_sample(x, "id", 500).collect()) for x in (df, df.repartition(9)))
    assert a == b and len(set(a)) == 500
    h = [r[0] for r in df.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 20)), F.xxhash64("id")).limit(500).collect()]
    assert sorted(h) == a and bounded_sample(df, "id", 60_000).count() == 50_000
    same = spark.range(3000).select(F.lit(1).alias("id"))  # one hot key: the filter would leave none or all
    assert bounded_sample(same, "id", 10).count() == 10
