"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from quantiva.llm import bpe, chat, decontaminate, minhash, quality, secrets, substring, suffixes, toxicity, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe_is_tiktoken(spark, tiny, empty):
    import numpy as np
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(path, P.PATTERN).ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in tiny.collect()}
    for r in rows(bpe.encode(tiny, path, P.PATTERN)):
        want = enc.encode_ordinary(text[r["doc_id"]] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == sha(np.array(want, "<u4").tobytes()) and r["decoded_sha256"] == sha(text[r["doc_id"]] or "")
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def brute_links(texts, width, percent):
    low = {i: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] for i, t in texts}
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for i, w in low.items()}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_minhash(tiny, width, percent):
    want = brute_links([(r["doc_id"], r["text"]) for r in tiny.collect() if r["doc_id"] is not None], width, percent)
    got = [r for r in rows(minhash.link(tiny, width, percent)) if r["doc_id"] is not None]
    assert len(got) == tiny.filter("doc_id is not null").count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_chain(spark):
    """Copies that are only linked through others are still one component."""
    base = [f"w{i}" for i in range(200)]
    docs = [(k, " ".join([*(f"z{j}" for j in range(4 * k)), *base[4 * k :]])) for k in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in rows(minhash.link(spark.createDataFrame(docs, "doc_id bigint, text string"), 5, 80))}
    assert got == {i: c for i, (_, c) in brute_links(docs, 5, 80).items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_sketch_and_bands_lose_no_more_than_stated(percent):
    import numpy as np

    rows, limit = minhash.band_rows(percent), minhash.most_ones(percent)
    assert (1 - (percent / 100) ** rows) ** (minhash.MINHASHES // rows) <= minhash.MISS
    rng = np.random.default_rng(3)  # pairs whose minima differ with the odds of the threshold
    differ = rng.random((20_000, minhash.MINHASHES)) > percent / 100
    ones = np.zeros(len(differ), int)
    for k in range(0, len(differ), 2000):
        flips = rng.integers(0, minhash.SKETCH_BITS, (2, *differ[k : k + 2000].shape))
        bits = np.zeros((len(flips[0]), minhash.SKETCH_BITS), bool)
        for side in flips:
            for j in range(minhash.MINHASHES):
                bits[np.arange(len(bits)), side[:, j]] ^= differ[k : k + 2000, j]
        ones[k : k + 2000] = bits.sum(axis=1)
    loss = minhash.sketch_losses(percent)
    assert loss[limit] <= minhash.MISS / 10
    for q in (0.5, 0.1, 0.01):  # the exact odds against simulated ones
        at = int(np.argmax(loss <= q))
        assert abs((ones > at).mean() - loss[at]) < 0.02


@pytest.mark.parametrize("block", [3, 1024])
def test_minhash_random(spark, monkeypatch, block):
    """Many families of near copies about the threshold, blocks of few members, exact copies, repeated ids and rows."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    docs = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(60)]
        for k in range(9):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + k, docs[k * 7][1]) for k in range(10)]
    want = brute_links(docs, 3, 85)
    df = spark.createDataFrame([*docs, docs[3], docs[3], (None, docs[0][1])], "doc_id bigint, text string")
    got = rows(minhash.link(df, 3, 85))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want and len(got) == len(docs) + 3
    null = next(r for r in got if r["doc_id"] is None)
    assert null["component_id"] is None and null["kept"] and null["n_shingles"] == want[0][0]
    assert minhash.link(df.limit(0), 3, 85).count() == 0


def test_minhash_id_with_several_texts(spark):
    words = lambda k: " ".join(f"w{k}_{j}" for j in range(30))
    df = spark.createDataFrame([(1, words(1)), (2, words(2)), (7, words(1)), (7, words(2)), (9, words(3))], "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in rows(minhash.link(df, 3, 85))}
    assert got == {(1, 1), (2, 1), (7, 1), (9, 9)}


def test_substring(tiny, empty):
    docs = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in tiny.collect()]
    least = {}
    for i, w in docs:
        for k in range(len(w) - 12) if i is not None else ():
            least[tuple(w[k : k + 13])] = min(least.get(tuple(w[k : k + 13]), i), i)
    want = {}
    for i, w in docs:
        gone = {j for k in range(len(w) - 12) if i is not None and least[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))
    for r in rows(substring.remove(tiny)):
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    assert substring.remove(empty).count() == 0


def test_suffixes(tiny, empty):
    docs = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in tiny.dropDuplicates(["doc_id"]).collect() if r["doc_id"] is not None))
    seen, want = set(), {}
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        want[i] = len(b), sum(gone), sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))
    for r in rows(suffixes.remove(tiny)):
        if r["doc_id"] is not None:
            assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    assert suffixes.remove(empty).count() == 0


def brute_repeats(docs, length=100):
    """``docs`` in order: bytes, removed bytes, removed runs and digest by id."""
    seen, want = set(), {}
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want[i] = len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return want


def copied_texts(seed, n, least=30):
    """Texts that copy passages of others and of themselves, at odd places and of lengths about the threshold."""
    import random

    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(80, 400))) for _ in range(12)]
    out = []
    for i in range(n):
        t = ""
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            k = rng.randrange(len(p) - 60)
            t += "".join(rng.choice("xyz ") for _ in range(rng.randrange(0, 60))) + p[k : k + rng.randrange(50, 300)]
        out.append((i, t))
    return out


@pytest.mark.parametrize(("parts", "hot", "flush"), [(1, 4096, 300_000), (5, 2, 500), (3, 4096, 2000)])
def test_suffixes_random(spark, monkeypatch, parts, hot, flush):
    """Hot anchors that are split, flushes in the middle of groups, pieces of long texts."""
    for name, v in (("HOT", hot), ("FLUSH", flush), ("PIECE", 1 << 10 if hot == 2 else 1 << 18)):
        monkeypatch.setattr(suffixes, name, v)
    docs = copied_texts(parts, 60)
    docs.append((60, "".join(t for _, t in docs[:30])))
    want = brute_repeats([(i, t.encode()) for i, t in docs])
    got = rows(suffixes.remove(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_suffix_index_grows(spark):
    """Batches in any order of ids: old levels are read, not rebuilt, and merged geometrically."""
    docs = copied_texts(21, 80)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = suffixes.SuffixIndex(spark)
    assert index.levels() == {} and index.spans().count() == 0
    seen, sizes = [], []
    for k in (2, 0, 3, 1):
        before = set(index.levels())
        index.add(df.filter(F.col("doc_id") % 4 == k))
        seen = sorted(seen + [d for d in docs if d[0] % 4 == k])
        after = set(index.levels())
        assert before & after or len(before) < 2 or len(after) == 1
        sizes.append(len(after))
        got = rows(suffixes.remove(df.filter(F.col("doc_id").isin([i for i, _ in seen])), index=index))
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats([(i, t.encode()) for i, t in seen])
    assert max(sizes) <= 3
    index.add(df.limit(0))
    assert index.spans().count() > 0


@pytest.mark.parametrize("parts", [1, 6])
def test_suffixes_repeated_rows(spark, parts):
    """Rows that repeat an id and text of over 100 bytes keep it; what other documents or the text itself repeat goes."""
    words = lambda a, n: " ".join(f"word{(a * 7919 + j * 31) % 99_991}" for j in range(n))
    own, shared, twice = words(1, 60), words(2, 60), words(3, 40)
    docs = [(1, own), (2, f"{words(4, 9)} {shared} {words(5, 9)}"), (3, f"{words(6, 9)} {shared} {words(7, 9)}"), (4, f"{twice} {words(8, 30)} {twice}"), (5, own[50:])]
    want = brute_repeats([(i, t.encode()) for i, t in docs])
    assert want[1][1] == want[2][1] == 0 < min(want[3][1], want[4][1], want[5][1])
    df = spark.createDataFrame([d for d in docs for _ in range(3)], "doc_id bigint, text string").repartition(parts)
    got = rows(suffixes.remove(df))
    assert len(got) == 15 and all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)


def test_decontamination(spark, tiny, empty):
    items = [(1, "the lazy dog and runs far away from here today my friend indeed"), (2, "WORD"), (3, None), (4, "  "), (2, "WORD")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in rows(decontaminate.report(decontaminate.mark(tiny, bench)))}
    assert got[0]["n_hit"] == 12 - 0 and got[0]["contaminated"] and got[0]["items_sha256"] == sha("1")
    assert got[5]["n_hit"] == 1 and got[5]["items_sha256"] == sha("2")
    assert not got[8]["contaminated"] and got[3]["n_words"] == 0 and got[8]["items_sha256"] == sha("")
    assert decontaminate.report(decontaminate.mark(empty, bench)).count() == 0
    assert not any(r["contaminated"] for r in rows(decontaminate.report(decontaminate.mark(tiny, bench.limit(0)))))


def brute_marks(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = low(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 1 << 27])
def test_decontamination_random(spark, monkeypatch, bits):
    """Few words, so that shingles tie in rarity and prefixes lie at all offsets; long items; a bitmap that is full."""
    import random

    monkeypatch.setattr(decontaminate, "MIN_BITS", min(bits, 1 << 16))
    monkeypatch.setattr(decontaminate, "MAX_BITS", bits)
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["a", "B", "c", "dé", "e5"]) + rng.choice([" ", "", "-"]) for _ in range(n))
    items = [(f"i{k}", say(rng.randrange(1, 30))) for k in range(30)] + [("long", say(400)), (7, ""), ("i1", say(12))]
    docs = [(k, f"{say(rng.randrange(40))} {rng.choice(items)[1]} {say(rng.randrange(40))}") for k in range(40)] + [(99, items[30][1]), (99, items[30][1]), (100, say(3000))]
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], "doc_id bigint, text string, bench_words int, text_sha string, shingle string")
    bench = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    marked = decontaminate.mark(df, bench)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_marks(docs, items)
    assert sorted(tuple(r[n] for n in names) for r in rows(decontaminate.report(marked))) == want
    assert marked.columns.count("bench_words") == 1 and {r["text_sha"] for r in rows(marked)} == {"x"}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in rows(kept)) == [w[0] for w in want if not w[5]]


def test_secrets(spark, tiny, empty):
    ledger = secrets.new_folder(spark, "test-ledger")
    base = [("assign", re.compile(secrets.ASSIGN), 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
    text = {r["doc_id"]: r["text"] or "" for r in tiny.collect()}
    for _ in range(2):  # the second scan finds everything in the ledger
        for r in rows(secrets.report(secrets.scan(tiny, ledger))):
            found = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, g, n) in enumerate(base) for m in p.finditer(text[r["doc_id"]]) if len(m.group(g)) >= (n if kind == "assign" else n))
            assert r["spans"] == ",".join(x[2] for x in found) and r["base_sha256"] == sha(r["spans"])
    assert spark.read.parquet(ledger).count() == len(set(text.values()))
    masked = {r["doc_id"]: r for r in rows(secrets.scan_texts(tiny))}
    assert "abcdef123456" not in masked[6]["text"] and masked[6]["n_chars"] == len(masked[6]["text"]) and masked[8]["text"] == text[8]
    assert secrets.report(secrets.scan(empty)).count() == 0


def test_quality(spark, tiny, empty):
    got = {r["doc_id"]: r for r in rows(quality.judge(tiny))}
    for i, t in ((r["doc_id"], r["text"] or "") for r in tiny.collect()):
        w, ls = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        rep = {j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(k, k + 5)} if len(wins) < 500 else None
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(ls) - len(set(ls)))
        assert rep is None or r["n_repeat_words"] == len(rep)
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w))
    assert quality.judge(empty).count() == 0


def test_quality_rejects_outliers(spark):
    clean = [(i, " ".join(f"word{(i * 7 + j * 13) % 997}" for j in range(80 + i % 40)), "en", "s") for i in range(120)]
    junk = [(999, " ".join(f"w{j}$$$###" for j in range(90)), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in rows(quality.judge(spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string, source string")))}
    assert not got[999] and sum(got[i] for i in range(120)) == 120


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_finds_the_minimum(spark, seed):
    """Against all subsets of a small group: the estimate's determinant is within a few percent of the least there is."""
    from itertools import combinations

    import numpy as np

    rng = np.random.default_rng(seed)
    n, h, p = 14, 10, len(quality.NAMES)
    x = rng.normal(size=(n, p)) * [0.5, 0.1, 0.05, 0.1, 0.1]
    x[:3] += 4  # outliers, fewer than are left out
    floor = np.diag([least**2 for _, least in quality.VECTOR])
    least = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + floor)[1] for c in combinations(range(n), h))
    rows_ = [("g", *map(float, v)) for v in x] + [("one", *map(float, x[0]))]
    core = spark.createDataFrame(rows_, "grp string, " + ", ".join(f"{c} double" for c in quality.NAMES))
    got = {r["grp"]: r for r in quality.least_determinant(core, h / n).collect()}
    assert got["g"]["logdet"] <= least + 0.05 and got["one"]["logdet"] == pytest.approx(np.linalg.slogdet(floor)[1])
    assert abs(quality.chi_square_limit(0.05, 5) - 11.0705) < 1e-3 and abs(quality.MEDIAN - 4.3515) < 1e-3


def test_quality_pools_small_groups(spark):
    """Sources under MIN_ROWS share their language's group, small languages one for all; null sources are one source."""
    say = lambda i: " ".join(f"word{(i * 7 + j * 13) % 997}" for j in range(80 + i % 40))
    clean = [(i, say(i), "en", f"s{i % 9}" if i % 9 else None) for i in range(90)]
    few = [(200 + i, say(i), f"l{i}", "s") for i in range(8)] + [(300 + i, say(i), None, None) for i in range(8)]
    junk = [(999, " ".join(f"w{j}$$$###" for j in range(90)), "en", "s3")]
    got = {r["doc_id"]: r["kept"] for r in rows(quality.judge(spark.createDataFrame(clean + few + junk, "doc_id bigint, text string, lang string, source string")))}
    assert not got.pop(999) and all(got.values()) and len(got) == 106


def test_quality_repeat_words(spark):
    """Windows found twice, in short and long texts, against counting."""
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 4, 5, 9, 40, 900)] + [" ".join(str(rng.randrange(3000)) for _ in range(3000)) + " x y z v w" * 2]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    for r in rows(quality.judge(df)):
        w = texts[r["doc_id"]].split()
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        assert r["n_repeat_words"] == len({j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 5)})


def test_toxicity(spark, tiny, empty):
    import random

    rng = random.Random(5)
    fill = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(40))
    plain = [(i, f"{fill()}. {fill()}", 0) for i in range(150)]
    rude = [(1000 + i, f"{fill()} you are a zorkhead, total grumblewort. {fill()}", 1) for i in range(90)]
    data = spark.createDataFrame(plain + rude, "doc_id bigint, text string, toxic int")
    grammar = toxicity.learn(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    scored = rows(toxicity.score(data.withColumn("held", toxicity.held_out()), grammar))
    assert all((r["toxic_score"] >= 0.7) == bool(r["toxic"]) for r in scored if r["held"])
    assert grammar.weight("you are not a zorkhead") < grammar.weight("you are a zorkhead")
    assert grammar.weight('she said "zorkhead"') < grammar.weight("zorkhead")
    assert len(rows(toxicity.score(tiny, grammar))) == tiny.count() and toxicity.score(empty, grammar).count() == 0
    assert toxicity.learn(empty.select("doc_id", "text"), data.select("doc_id", "toxic")).words == {}


def test_toxicity_grammar():
    """Quotes close, phrases of two words are one insult, and each transducer changes the weight as it should."""
    g = toxicity.Grammar({"zork": 1.0}, {}, {"wet sock": 1.0})
    plain = g.weight("zork")
    assert g.weight("you are a zork") > plain > g.weight("not a zork") and g.weight('"zork"') < plain
    assert g.weight('"hello" zork') == plain and g.weight('she wrote zork') < plain
    assert g.weight("such a wet sock") == plain and g.weight("wet day, old sock") == 0
    assert g.weight("I will kill you") > 0 > -g.weight("kill time")
    assert g.score(None) == g.score("") == g.score("nothing here")


def test_toxicity_ablation(spark):
    """Where harmless texts quote and negate the insults of toxic ones, the score needs the transducers."""
    import random

    rng = random.Random(9)
    fill = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(20))
    rude = [(i, f"{fill()}. you are a zorkhead. {fill()}", 1) for i in range(240)]
    plain = [(1000 + i, fill(), 0) for i in range(400)] + [(2000 + i, f'{fill()}. she said "zorkhead" there. {fill()}', 0) for i in range(8)]
    data = spark.createDataFrame(rude + plain, "doc_id bigint, text string, toxic int")
    g = toxicity.learn(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    assert g.words or g.prefixes
    aimed, quoted = g.score("you are a zorkhead"), g.score('she said "zorkhead" there')
    assert aimed >= toxicity.THRESHOLD and quoted < aimed and g.score("nobody here is a zorkhead") < aimed
    clash = data.withColumn("toxic_score", F.lit("x"))
    assert toxicity.score(clash, g).columns.count("toxic_score") == 1 and {type(r["toxic_score"]) for r in rows(toxicity.score(clash, g).limit(3))} == {float}
    kept = toxicity.keep_clean(clash, g)
    assert kept.columns == clash.columns and {r["toxic"] for r in rows(kept)} == {0}


def test_chat(spark):
    call = lambda *cs: json.dumps({"tool_calls": list(cs)})
    msgs = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call({"id": "b", "name": "calculate", "arguments": {"expression": {"$ref": "a"}}}, {"id": "a", "name": "search", "arguments": '{"query": "x", "limit": 2}'})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": 2}})), (1, 2, "tool", json.dumps({"tool_call_id": "zz", "content": 1})),
        (2, 0, "assistant", call({"id": "p", "name": "search", "arguments": {"query": {"$ref": "q"}}}, {"id": "q", "name": "search", "arguments": {"limit": 0}})), (2, 1, "assistant", call({"id": "q", "name": "nope", "arguments": {}})),
        (None, None, None, None), (3, 0, "assistant", "{not json"),
    ]
    df = spark.createDataFrame(msgs, "conv_id bigint, turn bigint, role string, text string")
    got = rows(chat.format_chat(df))
    by = {(r["conv_id"], r["kind"], r["call_id"], r["turn"]): r for r in got}
    assert len(got) == 10
    a, b = by[1, "call", "a", 1], by[1, "call", "b", 1]
    assert a["valid"] and b["valid"] and a["topo_level"] == 0 and b["topo_level"] == 2
    result = by[1, "result", "a", 3]
    assert result["link"] == "linked" and result["topo_turn"] == 1 and result["topo_level"] == 1
    assert result["json"] == '{"content":{"b":2,"z":1},"id":"a","role":"tool","type":"result"}'
    assert by[1, "result", "zz", 2]["link"] == "orphan_result" and by[2, "call", "q", 1]["link"] == "duplicate_call"
    assert by[2, "call", "q", 0]["problem"] == "$.query: missing" and by[2, "call", "p", 0]["topo_level"] == 2
    cycle = spark.createDataFrame([(1, 0, "assistant", call({"id": "p", "name": "search", "arguments": {"query": {"$ref": "q"}}}, {"id": "q", "name": "search", "arguments": {"query": {"$ref": "p"}}}))], df.schema)
    assert {r["link"] for r in rows(chat.format_chat(cycle))} == {"cyclic"}
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_reference_to_later_turn(spark):
    call = lambda i, need: json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": {"$ref": need} if need else "x"}}]})
    msgs = [(1, 0, "assistant", call("c", "b")), (1, 1, "assistant", call("b", "a")), (1, 5, "assistant", call("a", None)), (1, 6, "tool", json.dumps({"tool_call_id": "a", "content": 1})), (1, 7, "tool", json.dumps({"tool_call_id": "b", "content": 1}))]
    got = rows(chat.format_chat(spark.createDataFrame(msgs, "conv_id bigint, turn bigint, role string, text string")))
    got.sort(key=lambda r: (r["topo_turn"], r["topo_level"], r["turn"], r["place"]))
    assert [(r["call_id"], r["kind"]) for r in got] == [("a", "call"), ("a", "result"), ("b", "call"), ("b", "result"), ("c", "call")]


def test_chat_canonical():
    """Cases of RFC 8785, and whole numbers that keep their digits."""
    assert chat.canonical(json.loads('{"numbers":[333333333.33333329,1E30,4.50,2e-3,0.000000000000000000000000001],"string":"\\u20ac$\\u000F\\u000aA\'\\u0042\\u0022\\u005c\\\\\\"\\/","literals":[null,true,false]}')) == \
        '{"literals":[null,true,false],"numbers":[333333333.3333333,1e+30,4.5,0.002,1e-27],"string":"€$\\u000f\\nA\'B\\"\\\\\\\\\\"/"}'
    assert chat.canonical({"\ufb33": 1, "\U0001f600": 2, "é": 3, "a": 12345678901234567890}) == '{"a":12345678901234567890,"é":3,"\U0001f600":2,"\ufb33":1}'
    assert [chat.canonical(x) for x in (1e21, -0.0, 1e-7, 123456.789, 0.0000012, float("nan"), 5.0)] == ["1e+21", "0", "1e-7", "123456.789", "0.0000012", "null", "5"]


def test_chat_schemas():
    ok = lambda v, s: chat.violation(v, s) is None
    cases = [
        ({"type": "integer"}, [1, 2.0], [1.5, True, "1"]), ({"const": {"a": 1}}, [{"a": 1.0}], [{"a": 2}]), ({"pattern": "^a+$"}, ["aa", 3], ["ab"]),
        ({"maxLength": 2}, ["ab"], ["abc"]), ({"exclusiveMinimum": 0, "multipleOf": 0.5}, [1.5], [0, 0.7]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 4], [2]),
        ({"oneOf": [{"type": "number"}, {"type": "integer"}]}, [1.5], [1, "x"]), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1.5], [3]), ({"not": {"type": "null"}}, [1], [None]),
        ({"items": {"type": "string"}, "uniqueItems": True, "minItems": 1}, [["a"]], [[], [1], ["a", "a"]]), ({"additionalProperties": {"type": "integer"}, "properties": {"s": {"type": "string"}}}, [{"s": "x", "n": 1}], [{"n": "x"}]),
        ({"properties": {"x": False}}, [{"y": 1}], [{"x": 1}]), ({"type": ["string", "null"]}, ["a", None], [1]), ({"type": "string"}, [{"$ref": "z"}], [{"$ref": "z", "k": 1}]),
    ]
    for schema, good, bad in cases:
        chat.check_schema(schema)
        assert all(ok(v, schema) for v in good) and not any(ok(v, schema) for v in bad), schema
    for wrong in ({"format": "date"}, {"properties": {"a": {"$ref": "#"}}}, {"type": "text"}, {"anyOf": [{"if": {}}]}):
        with pytest.raises(ValueError):
            chat.check_schema(wrong)


def brute_levels(calls):
    """``calls`` (conversation, id) to (turn, needs): level and reach of each, -1 for circles."""
    out = {}

    def visit(key, above):
        if key in above:
            return -1, None
        if key in out:
            return out[key]
        turn, needs = calls[key]
        below = [visit((key[0], n), above | {key}) for n in needs if (key[0], n) in calls]
        got = (-1, None) if any(x[0] < 0 for x in below) else (1 + max((x[0] for x in below), default=-1), max([turn, *(x[1] for x in below)]))
        if not above or got[0] >= 0:
            out[key] = got
        return got

    return {k: visit(k, frozenset()) for k in calls}


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_order_random(spark, seed):
    """Chains, trees, references to later turns and to nowhere, and circles: each call comes after all that it needs."""
    import random

    rng = random.Random(seed)
    calls, msgs = {}, []
    for c in range(6):
        ids = [f"k{i}" for i in range(12)]
        for i, k in enumerate(ids):
            many = rng.choice([0, 1, 1, 1, 2, 3])
            pool = ids if c == 5 else ids[i + 1 :] + ["nowhere"]
            needs = sorted({rng.choice(pool) for _ in range(many)}) if c else ids[i + 1 : i + 2]
            calls[c, k] = rng.randrange(20), needs
    turns = {}
    for (c, k), (t, needs) in calls.items():
        turns.setdefault((c, t), []).append({"id": k, "name": "search", "arguments": {"query": "x", "with": [{"$ref": n} for n in needs]}})
        msgs.append((c, 20 + rng.randrange(5), "tool", json.dumps({"tool_call_id": k, "content": 1})))
    msgs += [(c, t, "assistant", json.dumps({"tool_calls": own})) for (c, t), own in turns.items()]
    tools = {"search": {"type": "object", "properties": {"with": {"type": "array"}}}}
    df = spark.createDataFrame([(*m, "x", 1) for m in msgs], "conv_id bigint, turn bigint, role string, text string, level string, need int")
    got = rows(chat.format_chat(df, tools))
    want = brute_levels(calls)
    assert len(got) == 2 * len(calls) and all(r["valid"] for r in got if r["kind"] == "call")
    for r in got:
        level, reach = want[r["conv_id"], r["call_id"]]
        if r["kind"] == "call":
            assert (r["link"] == "cyclic") == (level < 0)
            if level >= 0:
                assert (r["topo_level"], r["topo_turn"]) == (2 * level, reach)
    place = {(r["conv_id"], r["call_id"], r["kind"]): (r["topo_turn"], r["topo_level"], r["turn"], r["place"]) for r in got}
    for (c, k), (_, needs) in calls.items():
        for n in needs:
            if (c, n) in calls and want[c, k][0] >= 0:
                assert place[c, n, "call"] < place[c, n, "result"] < place[c, k, "call"]


def test_chat_edges(spark):
    """Repeated rows and keys, long texts, clashing columns, calls without arguments."""
    call = json.dumps({"tool_calls": [{"id": "a", "name": "calculate", "arguments": {"expression": "1" * 50_000}}, {"id": "b", "name": "calculate"}, "odd"]})
    data = [(1, 0, "assistant", call)] * 2 + [(1, 1, "user", '{"a": 1, "a": 2}'), (1, 2, "user", "y" * 200_000), (1, 3, "assistant", '{"tool_calls": [{"id": "c", "name": "calculate", "arguments": "{\\"expression\\": \\"x\\", \\"expression\\": \\"y\\"}"}]}')]
    df = spark.createDataFrame([(*d, "p", "q") for d in data], "conv_id bigint, turn bigint, role string, text string, place string, reach string")
    got = rows(chat.format_chat(df))
    by = {(r["turn"], r["call_id"]): r for r in got}
    assert len(got) == 9 and sum(r["kind"] == "message" for r in got) == 2
    assert by[0, "a"]["valid"] and not by[0, "b"]["valid"] and by[3, "c"]["problem"] == "$: no JSON"
    assert max(len(r["json"]) for r in got) > 200_000


def test_url_rules(spark):
    urls = ["http://WWW.example.com/en/1", "https://a.example.com/en/2?x=1", "http://b.net/es/", "http://b.net/de/1", "http://x.org", None, "no scheme", "http://com/", "http://notcom/", "ftp://u@h.example.com?q#f"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(100 + i, f"http://spam.net/es/{i}", "x") for i in range(50)] + [(200 + i, f"http://fine.com/de/{i}", "x") for i in range(50)], "page_id bigint, url string, rule string")
    got = {r["page_id"]: r for r in rows(url_rules.filter_urls(pages))}
    assert [got[i]["rule"] for i in range(10)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, "com/", None, None]
    assert got[0]["host"] == "www.example.com" and got[1]["path"] == "/en/2" and (got[5]["host"], got[5]["path"]) == ("", "")
    assert got[9]["host"] == "u@h.example.com" and got[9]["path"] == "" and got[2]["verdict"] == "block" and got[3]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert got[3]["mined"] == "seg:es"  # found in the same labelled rows as tld:net, for which it stands
    assert url_rules.filter_urls(pages.limit(0)).count() == 0


def brute_rules(labelled, least, confidence):
    """All token sets by enumeration, pruned like the mined ones; tokens of the same rows are one."""
    from collections import Counter
    from itertools import combinations

    places = {}
    for i, (tokens, _) in enumerate(labelled):
        for t in tokens:
            places.setdefault(t, set()).add(i)
    stands = {t: min(x for x in places if places[x] == p) for t, p in places.items()}
    total, base = len(labelled), Counter(lab for _, lab in labelled)
    sets, hits = Counter(), Counter()
    for tokens, lab in labelled:
        own = sorted({stands[t] for t in tokens})
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                sets[c] += 1
                hits[c, lab] += 1
    z, good = url_rules.Z_SCORE, {}
    for (c, lab), k in hits.items():
        n, p = sets[c], k / sets[c]
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        if k >= least and p >= confidence and low > base[lab] / total:
            good[lab, c] = p
    return {(c, lab) for (lab, c), p in good.items() if not any(good.get((lab, s), 0) >= p for j in range(1, len(c)) for s in combinations(c, j))}


def test_url_mining_is_enumeration(spark):
    import random

    rng = random.Random(8)
    data = []
    for _ in range(400):
        tokens = [t for t in "abcdefg" if rng.random() < 0.4] + (["x", "y", "z"] if rng.random() < 0.2 else [])
        bad = ("a" in tokens and "b" in tokens) or "x" in tokens or rng.random() < 0.05
        data.append((tokens, "block" if bad and rng.random() < 0.97 else "allow"))
    df = spark.createDataFrame([(t, lab) for t, lab in data] + [(["a"], None)], "tokens array<string>, label string")
    mined, stands = url_rules.mine(df)
    want = brute_rules(data, url_rules.MIN_COUNT, url_rules.MIN_CONFIDENCE)
    assert {(r["tokens"], r["label"]) for r in mined} == want and want
    assert stands["z"] == stands["y"] == stands["x"] == "x"
    many = spark.createDataFrame([([f"s{j}" for j in range(60)] + [str(i)], "block") for i in range(60)] + [(["q"], "allow")] * 60, "tokens array<string>, label string")
    assert {r["tokens"] for r in url_rules.mine(many)[0]} == {("s0",), ("q",)}


def test_url_held_out(spark):
    """Rules mined from two thirds of the listed pages give the listed verdicts of the last third."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    listed = url_rules.filter_urls(pages).filter("rule is not null").select("page_id", F.col("verdict").alias("label"))
    held = F.crc32(F.col("page_id").cast("string")) % 3 == 1
    got = url_rules.filter_urls(pages, rules=[], labels=listed.filter(~held)).join(listed.filter(held), "page_id")
    right, n = got.filter("verdict = label").count(), got.count()
    assert n > 100 and right / n > 0.95


def test_url_edges(spark):
    pages = spark.createDataFrame([(None, "http://a.net/es/" + "x/" * 20_000), (1, "http://b.com/x"), (1, "http://b.com/x"), (2, None)], "page_id bigint, url string")
    got = rows(url_rules.filter_urls(pages))
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in got) == [(0, "block"), (1, "allow"), (1, "allow"), (2, "allow")]


def test_pipeline_stages(spark, tiny, tmp_path):
    import corpus_pipeline as C

    tiny.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(8, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing in common with any other line of text at all truly nothing")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = C.run(spark, str(tmp_path))
    ids = sorted(r["doc_id"] for r in out.filter("doc_id is not null").collect())
    assert ids == [0, 3, 4, 5, 6, 7, 9] and out.filter("doc_id is null").count() == 1
    assert F.col("n_tokens") is not None and [n for n, _ in C.STAGES][0] == "toxicity"
