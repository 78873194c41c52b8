"""op11 to op13 against brute force: fingerprints and links, cuts and markers, whitening."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from quantiva.llm import fim, simhash, whitening


def naive_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, linked):
    """The least id reachable from each."""
    part = {i: i for i in ids}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        part[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints_of_edge_texts(spark, tiny):
    for r in tiny.join(simhash.fingerprints(tiny).withColumnRenamed("doc_id", "id"), tiny["doc_id"] == simhash.F.col("id")).select("text", "fp").collect():
        assert r["fp"] % 2**64 == naive_fingerprint(r["text"])
    for t in ("", " \t ", "one", "Two words", "ÀÉ İX x", "a b c " * 70_000, "x" * 300_000):
        assert simhash.fingerprint(t.encode()) % 2**64 == naive_fingerprint(t)


def test_simhash_links_all_rows(spark, tiny, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.link(tiny).collect())
    rows = [(r["doc_id"], naive_fingerprint(r["text"])) for r in tiny.collect()]
    fps = sorted({f for _, f in rows})
    to = classes(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2])
    least = {c: min((i for i, f in rows if to[f] == c and i is not None), default=None) for c in fps}
    assert got == sorted((i is None, i or 0, f"{f:016x}", least[to[f]]) for i, f in rows)
    assert {i: c for _, i, _, c in got if i in (3, 4)} == {3: 3, 4: 3}  # no words: zero, linked like any other
    assert simhash.link(empty).collect() == []


@pytest.mark.parametrize("segments,crowd", [(8, 64), (16, 64), (16, 2), (32, 0)])
def test_grid_join_loses_no_link(spark, monkeypatch, segments, crowd):
    """Chains of flipped bits around random fingerprints, and a ball so full that its cells are crowded."""
    rng = random.Random(segments)
    fps = {0, 2**64 - 1, 1 << 63, (1 << 63) | 1}
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(8)):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                f ^= 1 << b
    middle = rng.getrandbits(64)
    fps |= {middle ^ 1 << a ^ 1 << b for a in range(0, 64, 2) for b in range(a, 64, 3)}
    signed = lambda f: f - 2**64 if f >> 63 else f
    want = classes({signed(f) for f in fps}, [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    df = spark.createDataFrame([(f,) for f in want], "fp bigint")
    monkeypatch.setattr(simhash, "CROWD", crowd)
    assert segments > 8 and crowd == 64 or simhash.cells(df, segments).groupBy("cell").count().filter(f"count > {crowd}").count() > 0
    edges = [(r["u"], r["v"]) for r in simhash.links(df, segments).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 2 for a, b in edges)
    assert classes(want, edges) == want


def test_places_are_not_broadcast(spark, monkeypatch):
    """The planner doesn't know that a fingerprint has some thirty places, so their joins are by merging."""
    plans, written = {}, simhash.materialize

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, tag)

    monkeypatch.setattr(simhash, "materialize", noted)
    df = spark.createDataFrame([(f,) for f in (0, 1, 3, 1 << 40)], "fp bigint")
    assert classes([0, 1, 3, 1 << 40], [(r["u"], r["v"]) for r in simhash.links(df).collect()]) == {0: 0, 1: 0, 3: 0, 1 << 40: 0}
    assert {"simhash-cells", "simhash-links"} == set(plans) and not [tag for tag, p in plans.items() if "Broadcast" in p]


def test_segments_must_fit(spark):
    with pytest.raises(ValueError):
        simhash.cells(spark.range(1).selectExpr("id fp"), 12)


def naive_fim(i, text, unit="char"):
    text = text or ""
    if unit == "char":
        parts = list(text)
    elif unit == "line":
        parts = re.findall(r"[^\n]*\n|[^\n]+", text)
    else:
        blank = "\x20\\x09-\x0d"
        parts = re.findall(rf"\A[{blank}]*[^{blank}]+[{blank}]*|[^{blank}]+[{blank}]*|\A[{blank}]+", text)
    assert "".join(parts) == text
    n, seed = len(parts), hashlib.sha256(b"1:" + ("" if i is None else str(i)).encode()).hexdigest()
    h = [int(seed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text), text
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, sha(out), sha(text), out


@pytest.fixture(scope="module")
def long_texts(spark, tiny):
    """Texts around the sizes of chunks and pieces, characters and markers across their borders, and many copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé🙂ñ<>PSM\n") for _ in range(rng.randrange(1, 9)))
    sized = ["x" * n for k in (1, 2, 128, 129, 300) for n in (fim.CHUNK * k - 1, fim.CHUNK * k, fim.CHUNK * k + 1)]
    mixed = [" ".join(word() for _ in range(n)) for n in (3, 40, 4000, 30_000, 60_000)]
    across = [c * (at - k) + "<S>" + "🙂" * 40_000 for c in "x " for at in (fim.CHUNK, fim.SPLIT, 2 * fim.SPLIT) for k in range(4)]
    almost = ["y" * (fim.SPLIT - 1) + "<S" + "é" * 70_000 + "<" + "\n" * 200]
    texts = [*sized, *mixed, *across, *almost, "é" * fim.SPLIT, " \n" * fim.SPLIT, "<", "<P", "<P>"]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (None, None), (100, texts[0])] + [(1000 + i, texts[18]) for i in range(20)] + [(1003, texts[18])]
    return tiny.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("*", "'x' seed", "1 key", "2 n").repartition(3)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_fill_in_middle_is_naive(long_texts, empty, unit):
    key = lambda x: (x[0] is None, *map(str, x))
    want = sorted(((r["doc_id"], *naive_fim(r["doc_id"], r["text"], unit)) for r in long_texts.collect()), key=key)
    got = sorted((tuple(r) for r in fim.transform(long_texts, unit).collect()), key=key)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(empty, unit).collect() == []


def test_transition_functions_compose(spark):
    """Any cut of a text into chunks gives the function of the whole, from every state."""
    rng = random.Random(3)
    for unit in ("char", "word", "line"):
        a = fim.automaton(unit)
        step, begins = a.step.reshape(257, -1), a.begins.reshape(257, -1)
        for _ in range(20):
            text = "".join(rng.choice("ab <PSM>\né") for _ in range(rng.randrange(1, 3000))).encode()
            s = fim.scan(a, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            end, count, _, _ = fim.compose(s, np.arange(a.states)[None, :])
            for q in range(a.states):
                at, n = q, 0
                for b in text:
                    n += begins[b, at]
                    at = step[b, at]
                assert (end[0, q], count[0, q]) == (at, n)
            assert bool(a.marked[end[0, 0]]) == any(m.encode() in text for m in fim.MARKERS)
    with pytest.raises(ValueError):
        fim.automaton("page")


def naive_whitening(rows):
    sound = [(i, [math.floor(float(c) * 64) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}))
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    return n, [(i, sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True)), ((n * np.array(x) - s) / n) @ axes / np.sqrt(np.maximum(e, 1e-300))) for i, x in sound], e, axes


@pytest.mark.parametrize("dims,tile", [(5, 2), (40, 16), (33, 32)])
def test_whitening_is_numpy(spark, dims, tile):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(300, dims)) @ rng.normal(size=(dims, dims)) * 0.3 + rng.normal(size=dims)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(400)]
    bad = [(900, None), (901, [None] + [0.0] * (dims - 1)), (902, [float("nan")] * dims), (903, [float("inf")] * dims), (904, [1e30] * dims), (None, x[3].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "1 x", "2 n", "3 component").repartition(5)
    n, want, e, axes = naive_whitening([*rows, bad[-1]])
    got = whitening.whiten(df, tile=tile).collect()
    k = min(16, dims)
    assert len(got) == k * len(want) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for i, far, w in want:
        for c in range(k):
            r = by[i, c + 1].pop()
            sign = np.sign(axes[np.abs(axes[:, c]).argmax(), c])
            assert r["deviation"] == far and r["whitened"] == pytest.approx(w[c] * sign, abs=1e-7) and r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)


def test_whitening_edges(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 3, kind)).collect() == []  # one vector: nothing varies
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, 2.0 * i]) for i in range(4)] + [(9, [])], kind)).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 4 and {r["explained"] for r in flat} == {1.0}
    two = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i * i % 5)]) for i in range(9)] + [(20 + i, [float(i % 3)]) for i in range(9)], kind)).collect()
    assert {(r["vec_id"] >= 20, r["component"], r["n"]) for r in two} == {(False, 1, 9), (False, 2, 9), (True, 1, 3)}  # a space for each length
    far = whitening.whiten(spark.createDataFrame([(1, [1e12]), (2, [-1e12])], "vec_id bigint, embedding array<double>")).collect()
    assert [r["deviation"] for r in far] == [None, None] and sorted(r["whitened"] for r in far) == [-1.0, 1.0]


def test_chat_surrogates_and_depth(spark):
    """Halves of surrogate pairs stay escapes, and depth is one rule: 200 levels, whatever the length."""
    import json

    from quantiva.llm import chat

    half = '{"tool_calls": [{"id": "a\\ud800", "name": "search", "arguments": {"query": "x\\udc00y", "k\\ud801": 1}}]}'
    deep = lambda n: '{"tool_call_id": "d", "content": ' + "[" * (n - 1) + "]" * (n - 1) + "}"
    brackets = json.dumps({"tool_call_id": "s", "content": "[{" * 5000})
    msgs = [(1, 0, "assistant", half), (1, 1, "tool", '{"tool_call_id": "a\\ud800", "content": "\\ud83d\\ude00 \\ud800"}'), (1, 2, "tool", brackets)]
    msgs += [(2, i, "tool", deep(n)) for i, n in enumerate((200, 201, 900, 3000, 20_000, 200_000))]
    df = spark.createDataFrame(msgs, "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chat(df).collect()}
    assert got[1, 0]["link"] == got[1, 1]["link"] == "linked" and got[1, 0]["call_id"] == "a\\ud800" and not got[1, 0]["valid"]
    assert '"x\\udc00y"' in got[1, 0]["json"] and got[1, 1]["json"].count("\\ud800") == 2 and "\U0001f600" in got[1, 1]["json"]
    assert json.loads(got[1, 0]["json"])["arguments"]["query"] == "x\udc00y" and got[1, 2]["kind"] == "result"
    assert [got[2, i]["kind"] for i in range(6)] == ["result"] + ["message"] * 5


def test_ledger_read_once(spark, tiny, tmp_path):
    """A ledger that two scans wrote at once, and columns with the operator's own names."""
    from quantiva.llm import secrets

    ledger = f"{tmp_path}/ledger"
    once = sorted(map(str, secrets.report(secrets.scan(tiny, ledger)).collect()))
    spark.read.parquet(ledger).write.parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(ledger)
    size = spark.read.parquet(ledger).count()
    assert sorted(map(str, secrets.report(secrets.scan(tiny, ledger)).collect())) == once and spark.read.parquet(ledger).count() == size
    named = tiny.selectExpr("doc_id", "text", "'b' blob", "1 Found", "2 __blob")
    out = secrets.scan_texts(named, ledger)
    assert out.columns == named.columns and out.count() == named.count() and out.filter("blob <> 'b' or Found <> 1 or __blob <> 2").isEmpty()
    assert out.filter("text like '%[SECRET]%'").count() == 2


def test_suffix_levels_merge(spark, tiny):
    """Four batches make four levels of about one size, which are merged geometrically; the answer is that of one batch."""
    from quantiva.llm import suffixes

    docs = tiny.filter("doc_id is not null").select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, "shared passage that goes on and on for more than one hundred bytes so that it counts as a repeat " * 2 + str(i)) for i in range(40)], "doc_id bigint, text string"))
    index = suffixes.SuffixIndex(spark)
    suffixes.add_in_batches(index, docs, 4)
    assert index.merged >= 2 and len(index.levels()) < 4
    key = lambda d: sorted(map(str, d.collect()))
    assert key(suffixes.remove(docs, index=index)) == key(suffixes.remove(docs)) == key(suffixes.remove(docs, batches=3))


def test_part_counts_bound_what_sets_share():
    from quantiva.llm import minhash

    rng = np.random.default_rng(6)
    for n in (1, 40, 3000, 60_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([rng.permutation(a)[: n // 2 + 1], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        x, y = (minhash.part_counts(s).view(np.uint8).astype(int) for s in (a, b))
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b)) or x[0] == minhash.FULL or y[0] == minhash.FULL
        assert (x[0] == minhash.FULL) == (n == 60_000) and (n == 60_000 or x.sum() == len(a))
