"""Exact dedup, token counts, secrets, SentencePiece and SimHash."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import exact_dedup, graph, secrets, sentence_pieces as sp, simhash, token_counts as tc
from quadrille.llm.registry import table
from tests.llm.helpers import CLASHING, LONG, awkward, empty


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# -- exact dedup ---------------------------------------------------------------------------------------------------
def test_exact_classes_on_awkward_rows(spark):
    got = exact_dedup.classes(awkward(spark)).collect()
    assert len(got) == 13
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["kept"] and by[1][0]["group_size"] == 4 and by[7][0]["keep_id"] == 1
    assert [r["keep_id"] for r in by[2] + by[3]] == [2, 2] and by[2][0]["group_size"] == 3
    assert by[4][0]["kept"] and by[4][0]["group_size"] == 1  # one space is not the empty text
    assert by[5][0]["kept"] and not by[6][0]["kept"]
    assert not any(r["kept"] for r in by[None])
    assert by[5][0]["text_sha256"] == hashlib.sha256(normal(LONG).encode()).hexdigest()


def test_exact_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    assert Counter(r["kept"] for r in exact_dedup.classes(df).collect()) == {True: 3, False: 2}
    assert sorted(r["text"] for r in exact_dedup.dedup(df).collect()) == ["a b", "c", "d"]


def test_exact_dedup_keeps_columns(spark):
    out = exact_dedup.dedup(awkward(spark))
    assert out.columns == ["doc_id", "text", *CLASHING]
    assert sorted((normal(r["text"]) for r in out.collect()), key=len) == sorted({normal(r["text"]) for r in awkward(spark).collect()}, key=len)
    assert exact_dedup.dedup(empty(spark)).count() == 0 and exact_dedup.classes(empty(spark)).count() == 0


def test_exact_prefix_collision_is_refined(spark):
    df = spark.createDataFrame([(i, "p" * 300 + c) for i, c in enumerate("abba")], "doc_id long, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.classes(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 0}


# -- token counts --------------------------------------------------------------------------------------------------
def greedy(word, initial, continuing):
    i, n, pieces = 0, 0, initial
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        i, n, pieces = j, n + 1, continuing
    return n


def test_automaton_equals_greedy_match():
    rng = random.Random(3)
    word = lambda most: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, most)))
    for _ in range(200):
        initial, continuing = ({word(4) for _ in range(rng.randint(1, 6))} for _ in range(2))
        automaton = tc.Automaton(initial, continuing, b"")
        for _ in range(40):
            w = word(9)
            assert automaton.count(w) == greedy(w, initial, continuing)


def test_token_counts_whole_table(spark, sf):
    pieces = set(tc.read_ranks(tc.VOCABULARY))
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r["n_tokens"] for r in tc.count_tokens(docs).collect()}
    memo = {}
    for r in docs.collect():
        total = 0
        for w in (r["text"] or "").encode().split():
            total += memo.setdefault(w, None) or memo.__setitem__(w, greedy(b" " + w, pieces, pieces)) or memo[w]
        assert got[r["doc_id"]] == total


def test_token_counts_awkward(spark):
    got = tc.count_tokens(awkward(spark)).collect()
    assert len(got) == 13 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert tc.count_tokens(empty(spark)).count() == 0


# -- secrets -------------------------------------------------------------------------------------------------------
# The contract's patterns and the method's figures, written out here so that a wrong one in the library shows.
NAMES = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")
ASSIGNED = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGNED.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def allowed(s):
    words = any(w in s.lower() for w in ("example", "sample", "placeholder", "dummy", "changeme"))
    return bool(UUID.fullmatch(s)) or s.startswith(("sha256-", "sha384-", "sha512-")) or words or len(set(s)) == 1


def kinds(s):
    """Kind and least entropy of each class that a candidate belongs to."""
    digit, low, up = (any(c in x for c in s) for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = "".join(c for c in s if c not in "0123456789")
    hexadecimal = all(c in "abcdefABCDEF" for c in letters)
    if hexadecimal and digit and letters:
        yield 3, 3.0
    if digit and low and up and not hexadecimal:
        yield 4, 3.75
    if s.isalnum() and digit and letters and letters.islower() and not hexadecimal:
        yield 5, 3.5
    if s.isalnum() and digit and letters and letters.isupper() and not hexadecimal:
        yield 6, 3.5


def suspects(text):
    """Candidates with their place, then one-case stretches that are only a part of one."""
    whole = {(m.start(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)}
    yield from (c for c in whole if not allowed(c[1]))
    for piece in re.finditer(r"[A-Za-z0-9_-]{20,}", text):
        for m in () if allowed(piece[0]) else re.finditer(r"[A-Za-z0-9]{20,}", piece[0]):
            one_case = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and m[0] in (m[0].lower(), m[0].upper())
            if one_case and (piece.start() + m.start(), m[0]) not in whole:
                yield piece.start() + m.start(), m[0]


def entropy(text):
    found = []
    for at, s in suspects(text or ""):
        for kind, bits in kinds(s):
            folded, runs = s.lower() if kind == 3 else s, []
            for i in range(len(s) - 19):
                counts = Counter(folded[i : i + 20]).values()
                if -sum(c / 20 * math.log2(c / 20) for c in counts) >= bits - 1e-10:
                    a, b = at + i, at + i + 20
                    if runs and runs[-1][2] >= a:
                        runs[-1] = (runs[-1][0], kind, b)
                    else:
                        runs.append((a, kind, b))
            found += runs
    return found


def as_text(spans):
    return ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in sorted(spans))


CASES = [
    "token:token:abcdefgh", 'API_KEY = "abc123XYZ/+=" and passwd:\'short\'', "é😀 secret=abcdefgh AKIA" + "Z9" * 9, "deadbeef" * 9 + " tail",
    "x" + "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffee", "k=Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MEFCQ0RFRg/+x", "uuid 123e4567-e89b-12d3-a456-426614174000 ok",
    "password=" + "a1B2c3D4e5" * 30, "AKIA" + "A" * 15, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "sha256-Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5MEFCQ0RFRg", "passwordless token ring",
    "0123456789abcdef" * 4 + "z" + "Qw3Er5Ty7Ui9Op1As2Df4Gh6" * 3, "token=example0123456789abcdefABCDEF99",
]


def test_secrets_equal_brute_force(spark, sf):
    rng = random.Random(5)
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(15, 70))) for pool in ("0123456789abcdef", "ABCDEF0189", "abcz019", "AZQ019", "aZ0+/=_-", "ab1-", "k=3zX/") for _ in range(60)]
    texts = CASES + made + [f"x {made[i]} y={made[-i]}" for i in range(1, 200, 3)] + [r["text"] for r in table(spark, sf, "documents").collect()] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.report(df).collect():
        spans = base(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(as_text(spans).encode()).hexdigest()
        assert r["spans"] == as_text(spans + entropy(texts[r["doc_id"]])), texts[r["doc_id"]]


HEX20, BASE36, BASE32 = "9f86d081884c7d659a2f", "q7x2m9k4z8w1v6t3p5r0n2j8h4g6y1u9", "JBSWY3DPEHPK3PXPKRSXG5BAONQXMZJR"
GLUED = [
    ("key=" + HEX20, "entropy_hex:4:24"), ("/srv/app-x/" + HEX20.upper() + "/y", "entropy_hex:11:31"), (BASE36, "entropy_lower:0:32"), ("key-" + BASE36, "entropy_lower:4:36"),
    (BASE32, "entropy_upper:0:32"), ("OTP=" + BASE32 + "==", "entropy_upper:4:36"), ("é😀 sample/" + HEX20, "entropy_hex:10:30"), ("KEY_" + HEX20, "entropy_hex:4:24"),
    ("sample-" + HEX20, ""), ("id=123e4567-e89b-12d3-a456-426614174000", ""), ("sha256-" + BASE36, ""), ("a-plain-path/with-words-of/2024", ""), ("key=" + "ab12" * 8, "hex:4:36"),
]


def test_one_case_keys_and_keys_glued_to_names(spark):
    """Base36, base32 and hex stretches are scanned; the allow list holds against the stretch's own piece."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GLUED)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.report(df).collect()}
    assert [got[i] for i in range(len(GLUED))] == [want for _, want in GLUED]
    assert secrets.redact(df).where("doc_id = 3").first()["text"] == "key-[SECRET]"


def redacted(text):
    out, at = [], 0
    for a, _, b in sorted(base(text) + entropy(text)):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redaction(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in secrets.redact(df).collect():
        assert r["text"] == redacted(CASES[r["doc_id"]])
    out = secrets.redact(awkward(spark))
    assert out.columns == awkward(spark).columns
    before = {(r["doc_id"], r["text"]) for r in awkward(spark).collect()}
    after = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {a for a in after - before} == {(10, "[SECRET]")} and out.first()["__base"] == "own __base"
    assert secrets.redact(empty(spark)).count() == 0 and secrets.report(empty(spark)).count() == 0


def test_secret_scan_runs_no_python(spark, sf):
    plan = secrets.report(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# -- SentencePiece -------------------------------------------------------------------------------------------------
TOY = [("▁", 0, -1.0), ("a", 1, -1.2), ("b", 2, -1.5), ("ab", 3, -2.0), ("▁a", 4, -1.7), ("aa", 5, -2.1), ("▁ab", 6, -3.0)]
MODEL = [("piece", i, w, p.encode()) for p, i, w in TOY] + [("byte", 10 + b, 0.0, bytes([b])) for b in range(256)] + [("weight", 0, -6.0, b"")]


def all_paths(text):
    if not text:
        return [((), 0.0)]
    return [((i, *rest), w + x) for p, i, w in TOY if text.startswith(p) for rest, x in all_paths(text[len(p) :])]


def test_samples_follow_the_exact_law(spark):
    text, n = "aab ab", 20_000
    paths = all_paths("▁" + text.replace(" ", "▁"))
    z = sum(math.exp(w) for _, w in paths)
    p = {i: math.exp(w) / z for i, w in paths}
    rows = sp.encode(spark.range(n).selectExpr("id AS doc_id", f"'{text}' AS text"), model=MODEL, samples=3, temperature=1.0).toPandas().sort_values(["doc_id", "sample"])
    one, two, estimate = Counter(), Counter(), 0.0
    for _, g in rows.groupby("doc_id"):
        ids = [tuple(x) for x in g.ids]
        assert len(set(ids)) == 3 and list(g.perturbed) == sorted(g.perturbed, reverse=True)
        assert np.allclose(g.log_prob, [math.log(p[i]) for i in ids])
        one[ids[0]] += 1
        two[ids[0], ids[1]] += 1
        estimate += sum(p[i] / q for i, q in zip(ids, g.inclusion, strict=True))
    assert max(abs(one[i] / n - p[i]) for i in p) < 0.015
    assert max(abs(two[i, j] / n - p[i] * p[j] / (1 - p[i])) for i in p for j in p if i != j) < 0.01
    assert abs(estimate / n - 1) < 0.03  # inclusion scores make the total an unbiased estimate of one


def test_samples_exhaust_small_lattices(spark):
    rows = sp.encode(spark.createDataFrame([(1, "aab ab")], "doc_id long, text string"), model=MODEL, samples=50, temperature=1.0).collect()
    assert {tuple(r["ids"]) for r in rows} == {i for i, _ in all_paths("▁aab▁ab")} and len(rows) == len(all_paths("▁aab▁ab"))
    assert all(r["inclusion"] == 1.0 for r in rows)


def test_sentencepiece_round_trip(spark, sf):
    docs = table(spark, sf, "documents").union(spark.createDataFrame([(-1, "a▁b  c\n\n d😀", "", "", 0), (-2, None, "", "", 0), (-3, "", "", "", 0)], table(spark, sf, "documents").schema))
    got = sp.encode(docs, digest=True).toPandas()
    assert got.round_trip.all() and got.groupby("doc_id").ids_sha256.nunique().min() == 1
    assert (got[got.doc_id >= 0].groupby("doc_id").size() == 2).all()
    back = sp.decode(sp.encode(docs)).select("doc_id", "text").distinct().toPandas().set_index("doc_id").text
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in docs.collect())
    again = sp.encode(docs.repartition(7), digest=True).toPandas()
    key = ["doc_id", "sample"]
    assert got.sort_values(key).ids_sha256.tolist() == again.sort_values(key).ids_sha256.tolist()
    assert sp.encode(empty(spark)).count() == 0 and sp.encode(awkward(spark)).count() >= 13


# -- SimHash -------------------------------------------------------------------------------------------------------
def plain_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(ids, fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        least[root(f)] = min(least.get(root(f), i), i)
    return [least[root(f)] for f in fps]


def test_simhash_equals_brute_force(spark, sf):
    rows = table(spark, sf, "documents").collect()
    fps = [plain_simhash(r["text"]) for r in rows]
    want = least_reachable([r["doc_id"] for r in rows], fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, sf, "documents")).collect()}
    for r, f, w in zip(rows, fps, want, strict=True):
        assert got[r["doc_id"]]["fingerprint"] == f"{f:016x}" and got[r["doc_id"]]["component_id"] == w


@pytest.mark.parametrize("most", [1, 3, 20, 4096])
def test_links_survive_refinement_of_hot_postings(spark, most):
    rng = random.Random(most)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r["node"] % (1 << 64): r["component"] for r in graph.components(simhash.links(nodes, most)).collect()}
    want = least_reachable(range(len(fps)), fps)
    groups = defaultdict(set)
    for f, w in zip(fps, want, strict=True):
        groups[w].add(found.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def plain_wide(text):
    """The wide fingerprint, bit by bit."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    m, mask = [int(x) for x in simhash._MULTIPLIERS], (1 << 64) - 1
    hashes = []
    for h in {xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams}:
        out = b""
        for i in range(8):
            x = h * m[i] & mask
            x = (x ^ x >> 29) * m[7 - i] & mask
            out += (x ^ x >> 32).to_bytes(8, "little")
        hashes.append(out)
    bits = [2 * sum(h[b // 8] >> (7 - b % 8) & 1 for h in hashes) > len(hashes) for b in range(512)]
    return sum(1 << b for b, on in enumerate(bits) if on)


def least_similar(rows):
    """Smallest id that links of wide fingerprints reach, by all pairs: doc_id -> least."""
    prints = {i: plain_wide(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 512 * math.acos(1.6 / 1.8) / math.pi:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in rows}


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(len(sets[0] | sets[1]), 1)


def test_similar_texts_are_found(spark):
    """Copies of random texts with more and more words changed: alike ones meet, others and clean ones do not."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    rows, want = [], {}
    for g in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(150, 500))]
        copy = list(text)
        for i in rng.sample(range(len(text)), g % 12 * len(text) // 180):
            copy[i] = rng.choice(words)
        rows += [(2 * g, " ".join(text)), (2 * g + 1, "  ".join(copy).upper())]
        want[g] = jaccard(" ".join(text), " ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = {g for g in want if got[2 * g + 1] == 2 * g}
    assert all(got[2 * g + 1] in (2 * g, 2 * g + 1) and got[2 * g] == 2 * g for g in want)
    assert {g for g, j in want.items() if j >= 0.88} <= joined and not {g for g in joined if want[g] < 0.68}
    assert sum(want[g] > 0.85 for g in want) > 30 and sum(want[g] < 0.68 for g in want) > 10


def test_similar_equals_brute_force(spark, sf):
    """Recall of the index against all pairs of fingerprints, and of fingerprints against exact Jaccard."""
    rows = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    fps = {i: simhash.wide_simhash(t) for i, t in rows.items()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(table(spark, sf, "documents")).collect()}
    assert set(got) == set(rows)
    ids, links, alike = sorted(rows), 0, [0, 0]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            d = int(np.bitwise_count(fps[a] ^ fps[b]).sum())
            if d <= simhash.most_bits(0.8):
                links += 1
                alike[0] += got[a] == got[b]
            if got[a] == got[b] == a:
                assert jaccard(rows[a], rows[b]) >= 0.6 or got[b] != b
    assert links > 5 and alike[0] / links >= 0.95


def test_postings_of_wide_fingerprints():
    """No two triples share two positions, every position is used alike, and most random pairs at 0.8 meet in one."""
    pairs = [tuple(sorted(p)) for t in simhash.TRIPLES.tolist() for p in combinations(t, 2)]
    assert len(set(pairs)) == len(pairs) == 3 * len(simhash.TRIPLES) and len(set(np.bincount(simhash.TRIPLES.ravel()))) == 1
    rng, met = random.Random(8), 0
    for _ in range(60):
        text = [f"w{rng.randint(0, 10**7)}" for _ in range(400)]
        copy = list(text)
        for i in rng.sample(range(4, 400, 6), 9):  # nine words apart from each other: 45 of 396 shingles
            copy[i] = "new" + copy[i]
        same = simhash.wide_simhash(" ".join(text)) == simhash.wide_simhash(" ".join(copy))
        met += bool(same[simhash.TRIPLES].all(axis=1).any())
    assert met >= 42


@pytest.mark.parametrize("copies", [3, 400])
def test_hot_groups_of_near_copies(spark, copies):
    """Hundreds of texts that differ in one word each are one component, whatever else is there."""
    rng = random.Random(copies)
    text = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
    rows = [(i, " ".join([*text[: i % 200], f"new{i}", *text[i % 200 + 1 :]])) for i in range(copies)] + [(1000 + i, " ".join(f"v{rng.randint(0, 3000)}" for _ in range(90))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()}
    assert all(c == (0 if i < 1000 else i) for i, c in got.items()) and simhash.dedup(df).count() == 51


def test_similar_loses_no_link(spark):
    """Pairs about the threshold, all with one common passage: exactly those that all pairs of fingerprints link."""
    rng = random.Random(11)
    passage, rows = [f"p{i}" for i in range(40)], {}
    for g in range(90):
        text = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        copy = list(text)
        for i in rng.sample(range(4, 200, 6), rng.randint(3, 6)):
            copy[i] += "x"
        rows |= {2 * g: " ".join(passage + text), 2 * g + 1: " ".join(copy + passage)}
    want = least_similar(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == want and 30 < sum(i != c for i, c in want.items()) < 90


def test_links_across_components_of_a_posting():
    """Postings that go over batches: a spanning forest of the links between components."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (3, 8), np.uint64)
    fp = np.repeat(base, 20, axis=0)
    fp[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 60).astype(np.uint64)
    key, part = np.repeat([4, 9], [40, 20]), np.arange(60) // 2
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7]), pa.array(part[i : i + 7]), pa.array([f.tobytes() for f in fp[i : i + 7]], pa.binary())], names=["key", "component", "fp"]) for i in range(0, 60, 7)]
    pairs = [p for b in simhash._across(77)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(pairs) == 27 and all(a // 10 == b // 10 for a, b in pairs)


def test_planes_cover_all_triples():
    assert len(simhash.PLANES) == 14
    assert all(sum(set(t) <= set(p) for p in simhash.PLANES) == 1 for t in combinations(range(8), 3))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_awkward(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == 13
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2} and {r["fingerprint"] for r in got if r["doc_id"] == 2} == {"0" * 16}
    kept = simhash.dedup(awkward(spark))
    assert kept.columns == awkward(spark).columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 5, 8, 9, 10}
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.dedup(empty(spark)).count() == 0
