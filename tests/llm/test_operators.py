"""Each operator against brute force, and over nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import chat, components, decontamination, katz, knn, licenses, lines, mixing, near_copies, queries, simhash, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """rows: (doc_id, text[, source])"""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1) for r in rows], DOCS)


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, repeated lines, nulls and empties."""
    rng = random.Random(5)
    texts = ["\n".join(words(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    for _ in range(20):
        t = rng.choice(texts)
        at = rng.randrange(len(t))
        texts.append(t[:at] + "x" + t[at + 1 :])
    texts += [texts[3]] * 4 + ["", "  \n ", None, "One", "two words", "Ünïcode ẞ straße", words(rng, 3000)]
    rows = [(i, t, rng.choice(["a", "b", "c", None, "dd"])) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[5], "a"), (None, None, None)]


# --- components -------------------------------------------------------------------------------------------------


def classes_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = classes_of({x for p in links for x in p}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 ----------------------------------------------------------------------------------------------------------


def edits_inside(item, text):
    """The least edits of item against any part of text."""
    d = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, d[0] = d[0], i
        for j, t in enumerate(text, 1):
            last, d[j] = d[j], min(last + (c != t), d[j] + 1, d[j - 1] + 1)
    return min(d)


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randrange(8, 25), 3000)) for i in range(12)] + [(12, "short one"), (13, None), (14, ""), (15, "  MiXed   Case item of the benchmark, twenty characters ")]
    rows = []
    for n in range(60):
        text = words(rng, rng.randrange(5, 60), 3000)
        if n % 2:
            _, item = rng.choice(items[:12])
            item = list(item)
            for _ in range(rng.randrange(0, len(item) // 6)):
                item[rng.randrange(len(item))] = rng.choice("xyz ")
            text = f"{text} {''.join(item)} {words(rng, 5)}"
        rows.append((n, text))
    rows += [(60, None), (61, ""), (62, "Short  ONE"), (63, "a short one"), (64, "a mixed case ITEM of\nthe benchmark, twenty characters b"), (None, items[0][1]), (1, rows[1][1])]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(docs_of(spark, rows), bench, at_once=2000).collect()}
    want = set()
    for d, text in rows:
        t = decontamination.normalised(text)
        for i, item in items:
            item = decontamination.normalised(item)
            if 0 < len(item) < 20:
                if t == item:
                    want.add((d, i, 0))
            elif item and (e := edits_inside(item, t)) <= min(len(item) // 10, len(item) // 8 - 1):
                want.add((d, i, e))
    assert got == want and len(want) > 10
    assert {r[0] for r in got} >= {62, 64, None} and 63 not in {r[0] for r in got}
    split = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontamination.contaminated(docs_of(spark, rows), bench, block_chars=300).collect()}
    assert split == want
    left = decontamination.clean(docs_of(spark, rows), bench)
    assert left.columns == docs_of(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in {w[0] for w in want})
    assert decontamination.contaminated(docs_of(spark, []), bench).count() == 0
    assert decontamination.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_regions(spark):
    """As many regions as copies were put in, where they were put; ids of items may be texts."""
    rng = random.Random(8)
    item = words(rng, 14, 3000)
    rows, want = [], {}
    for n in range(1, 6):
        for between in ("", " ", " x ", f" {words(rng, 30, 3000)} "):
            text, at = "", []
            for _ in range(n):
                text += between if text else "start "
                at.append(len(text))
                text += item
            rows.append((len(rows), text + " end"))
            want[len(rows) - 1] = ("i-1", 0, n, at[0], at[0] + len(item))
    cut = item[:30] + item[33:]
    rows.append((len(rows), f"before {cut} after"))
    want[len(rows) - 1] = ("i-1", 3, 1, 7, 7 + len(cut))
    got = decontamination.contaminated(docs_of(spark, rows), spark.createDataFrame([("i-1", item)], "item_id string, text string")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


# --- 2 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, corpus, tmp_path, name):
    import public_tokenizers

    path, cache = public_tokenizers.path(name), f"file://{tmp_path}/cache"
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(path)
        count = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    rows = [*corpus, (900, "</s> <s> <unk> <|endoftext|> x"), (901, "a b" * 9000)]
    got = token_counts.token_counts(docs_of(spark, rows).withColumnRenamed("lang", "digest"), path, cache)
    want = Counter((d, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for d, t, *_ in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    held = spark.read.parquet(cache)
    assert held.count() == len({t or "" for _, t, *_ in rows})  # each distinct text once
    token_counts.token_counts(docs_of(spark, [*rows, (902, "new")]), path, cache).collect()
    assert spark.read.parquet(cache).count() == held.count() + 0 or spark.read.parquet(cache).where("n_tokens >= 0").count() == len({t or "" for _, t, *_ in rows}) + 1
    assert token_counts.token_counts(docs_of(spark, []), path).count() == 0


# --- 3 ----------------------------------------------------------------------------------------------------------


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, t in enumerate(b, 1):
            last, d[j] = d[j], min(last + (c != t), d[j] + 1, d[j - 1] + 1)
    return d[-1]


def lines_without(rows, limit, min_chars=20):
    """The texts of the distinct (id, text) of rows, by brute force."""
    def hashed(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    docs = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    occ = [(d, t, n, x.strip(" \t\r")) for d, t in docs for n, x in enumerate(t.split("\n")) if t and x.strip(" \t\r")]
    distinct = sorted({o[3] for o in occ})
    long = [x for x in distinct if len(x) >= min_chars]
    links = [(a, b) for i, a in enumerate(long) for b in long[i + 1 :] if abs(len(a) - len(b)) <= limit and distance(a, b) <= limit]
    of = classes_of(distinct, links)
    first = {}
    for d, t, n, x in occ:
        key = (d is not None, d or 0, n)
        if of[x] not in first or key < first[of[x]][0]:
            first[of[x]] = (key, d, t, n)
    gone = {(d, t, n) for d, t, n, x in occ if first[of[x]][1:] != (d, t, n)}
    return {(d, t): "\n".join(x for n, x in enumerate(t.split("\n")) if (d, t, n) not in gone) for d, t in docs}


@pytest.mark.parametrize(("limit", "few"), [(1, 4), (1, 0), (1, 1), (2, 4), (2, 1)])
def test_line_dedup(spark, limit, few):
    rng = random.Random(limit)
    base = [words(rng, rng.randrange(1, 12), 5000) for _ in range(40)]
    near = []
    for _ in range(80):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randrange(2)] = rng.choice(["", "q", "z"])
        near.append("".join(x))
    page = "this line is about page number 000 of many others"
    near += [page.replace("000", f"{n:03d}") for n in range(30)]
    near += [page.replace("000", f"{n}") for n in range(9)] + ["aaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaabaaaaaaaaaaaaa"]
    rows = []
    for d in range(40):
        rows.append((d, "\n".join(rng.choice([*base, *near, "", "  ", " " + base[0] + "\t"]) for _ in range(rng.randrange(1, 9)))))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, base[0] * 300), rows[7], (None, base[1])]
    df = docs_of(spark, rows).withColumnsRenamed({"lang": "th", "source": "line"})
    out = lines.dedup_lines(df, limit=limit, few=few)
    assert out.columns == [*df.columns, "_lines", "_removed"]
    want = lines_without(rows, limit)
    got = out.collect()
    assert len(got) == len(rows)
    for r, original in [(r, r["doc_id"]) for r in got]:
        texts = [t for d, t in rows if d == original]
        assert r["text"] in [want[original, t] if t else t for t in texts] or (r["text"] or "") == "" == (texts[0] or "")
    assert sum(r["_removed"] for r in got) > 20
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1, 2])
def test_line_links_in_a_hot_group(spark, limit):
    """All pairs of lines that share nearly everything, at lengths around each halving, against brute force."""
    rng = random.Random(limit)
    every = set()
    for n in (20, 21, 22, 23, 24, 31, 32, 33, 40):
        base = "".join(rng.choice("abcd") for _ in range(n))
        every.add(base)
        for _ in range(25):
            x = list(base)
            for _ in range(rng.randrange(1, limit + 2)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "zz"])
            every.add("".join(x))
    texts = sorted(x for x in every if len(x) >= 20)
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "a long, b long, line string")
    want = [(i, j) for i, x in enumerate(texts) for j in range(i) if abs(len(x) - len(texts[j])) <= limit and distance(x, texts[j]) <= limit]
    for few in (0, 2):
        got = [(r["u"]["a"], r["v"]["a"]) for r in lines.line_links(df, limit, few).collect()]
        assert {(max(p), min(p)) for p in got} <= set(want)
        assert classes_of(range(len(texts)), got) == classes_of(range(len(texts)), want)


def test_line_pairs_stay_in_proportion(spark):
    """Lines that share a half, and lines that share all but one word: no pairs of all with all."""
    rng = random.Random(3)
    texts = [f"{'the same beginning of a common line ' * 2}{rng.getrandbits(120):030x}" for _ in range(600)]
    texts += [f"one of many near copies says w{rng.getrandbits(28):07x} in the middle of its only line" for _ in range(600)]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "a long, b long, line string")
    assert lines.candidates(df, 1, 4).count() < 6 * len(texts)


def test_line_pairs_are_made_round_by_round(spark):
    """The driver holds some MB for each stage and scan of a plan: pairs of all rounds are read in one scan, not joined at once."""
    page = "one of many near copies says w000000 in the middle of its only line"
    df = spark.createDataFrame([(n, 0, page.replace("000000", f"{n:06d}")) for n in range(120)], "a long, b long, line string")
    for few, some in ((4, df), (0, df), (4, df.where("a = 0")), (4, df.where("a < 0"))):
        pairs = lines.candidates(some, 1, few)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Union" not in plan
        assert (pairs.count() > 0) == (some is df)


def test_long_lines(spark):
    """Lines of 300,000 characters, alone and with many that share their halves."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000)).strip()
    near = [long, "x" + long[1:], long[:150_000] + long[150_001:], long[:-1], long[:262_144] + "q" + long[262_144:], long[:77] + "xy" + long[79:]]
    rows = list(enumerate(near))
    for few in (4, 1):
        got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, rows), few=few).collect()}
        assert got == {0: long, 1: "", 2: "", 3: "", 4: "", 5: near[5]}


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_banded_distance(spark, limit):
    rng = random.Random(limit)
    pairs = []
    for n in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(20, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, limit + 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "d"])
        b = "".join(b)
        if abs(len(a) - len(b)) <= limit:
            pairs.append((n, a, b))
    got = {r["n"] for r in lines._near(spark.createDataFrame(pairs, "n int, s string, t string"), limit).collect()}
    assert got == {n for n, a, b in pairs if distance(a, b) <= limit}


# --- 4 ----------------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, corpus):
    df = docs_of(spark, corpus).withColumnsRenamed({"lang": "fp", "source": "root"})
    got = simhash.simhash(df).collect()
    fps = {f"{fingerprint(t):016x}" for _, t, *_ in corpus}
    of = classes_of(fps, [(a, b) for a in fps for b in fps if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3])
    least = {}
    for d, t, *_ in corpus:
        if d is not None:
            root = of[f"{fingerprint(t):016x}"]
            least[root] = min(least.get(root, d), d)
    want = Counter((d, f"{fingerprint(t):016x}", least[of[f"{fingerprint(t):016x}"]]) for d, t, *_ in corpus)
    assert Counter(tuple(r) for r in got) == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.simhash(docs_of(spark, [])).count() == 0
    assert simhash.one_of_each(docs_of(spark, [(None, "a"), (None, "b c d e"), (None, "a")])).count() == 2


@pytest.mark.parametrize("group", [2048, 4])
def test_close_links(spark, group):
    rng = random.Random(group)
    centers = [rng.getrandbits(64) for _ in range(20)]
    fps = set()
    for _ in range(400):
        x = rng.choice(centers)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [simhash._signed(x) for x in fps]
    links = [tuple(r) for r in simhash.close_links(spark.createDataFrame([(x,) for x in signed], "fp long"), group=group).collect()]
    want = classes_of(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3])
    assert classes_of(signed, links) == want


@pytest.mark.parametrize(("group", "sample", "hot"), [(8, 8, 4096), (64, 1, 4096), (3, 1, 4096), (3, 1, 20)])
def test_near_copies(spark, group, sample, hot):
    """The pipeline's stage against all pairs; many of these copies differ in more bits than op4 links."""
    import corpus_pipeline

    rng = random.Random(group)
    passage = words(rng, 12, 5000).split()
    texts = []
    for _ in range(12):
        base = words(rng, rng.randrange(40, 120), 5000).split() + passage
        for _ in range(8):
            x = list(base)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = f"y{rng.randrange(9999)}"
            texts.append(" ".join(x))
    texts += ["", None, " ", "one two", "One  two", texts[0]]
    grams = []
    for t in texts:
        w = (t or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    n = range(len(texts))
    root = classes_of(n, [(a, b) for a in n for b in n if a < b and alike(grams[a], grams[b])])
    df = docs_of(spark, list(enumerate(texts)))
    got = near_copies.one_of_each(df, group=group, sample=sample, hot=hot)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))
    if group == 8:
        assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, df, "").collect()) == sorted(set(root.values()))
    assert near_copies.one_of_each(docs_of(spark, [])).count() == 0
    again = docs_of(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (None, ""), (2, "x"), (2, "x")])
    assert sorted(str(r["doc_id"]) for r in near_copies.one_of_each(again).collect()) == ["1", "2", "None"]


def test_shared_shingles_in_parts():
    """A shingle that goes on over many batches, and is sent on before its end."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.choice([1, 2, 3, 3, 3, 3, rng.randrange(100)]), rng.randrange(400), 9, 5) for _ in range(3000))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 70]], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["gram", "node", "n", "at"]) for at in range(0, 3000, 70)]
    of = Counter(r[0] for r in set(rows))
    want = sorted((*r, of[r[0]] > 8) for r in set(rows) if of[r[0]] > 1)
    for at_once in (10, 200, 1 << 16):
        got = [tuple(r.values()) for b in near_copies._shared(8, at_once)(iter(batches)) for r in b.to_pylist()]
        assert sorted((*r[:4], r[4] > 8) for r in got) == want


def test_sketches():
    """Sketches of any two sizes never differ by more than the sets, and seldom by much less."""
    rng = np.random.default_rng(2)
    for n, m in ((0, 3), (5, 5), (100, 130), (700, 560), (4000, 4100), (9000, 7300)):
        pool = rng.integers(-(1 << 63), 1 << 63, 2 * max(n, m), dtype=np.int64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 4 : n // 4 + m])
        d = len(np.setxor1d(a, b))
        got = near_copies.apart(near_copies._sketch(a), near_copies._sketch(b))
        assert d * 0.5 <= got <= d


def test_fingerprint_chunks():
    text = words(random.Random(1), 500)
    assert simhash.fingerprint(text, chunk=7) == simhash.fingerprint(text) == fingerprint(text)


# --- 5 ----------------------------------------------------------------------------------------------------------


def test_mixing(spark, corpus):
    size = lambda t: len(WORD.findall(t or ""))
    rows = [*corpus, *[(5000 + i, f"a b c {i}", "ee") for i in range(300)], *[(7, "copy of a row", "a")] * 9, (8000, "", "zero"), (8001, None, "zero")]
    got = mixing.mix_sizes(docs_of(spark, rows).withColumnsRenamed({"lang": "src", "n_chars": "m"})).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:  # the excess is shared again until none is above
        rest = sum(total.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in over} if over else share
        open_ -= over or open_
    by = dict((r["size"], r["source_size"]) for r in got)
    assert by
    taken, largest = Counter(), Counter()
    source = {(d, size(t)): s for d, t, s in rows}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    if len({source[k] for k in source}) == len(order):
        for s in order:
            assert abs(taken[s] - target[s]) <= largest[s] + 9 * 4 + 1e-6, s
    for r in got:
        assert math.isclose(r["target"], target[source[r["doc_id"], r["size"]]], rel_tol=1e-9, abs_tol=1e-9)
    again = mixing.mix_sizes(docs_of(spark, rows[::-1])).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in got)
    mixed = mixing.mix(docs_of(spark, rows).withColumnRenamed("lang", "total"))
    assert mixed.columns == ["doc_id", "text", "total", "source", "n_chars"]
    out = Counter((r["source"]) for r in mixed.collect() for _ in range(size(r["text"])))
    for s in order:
        assert abs(out[s] - target[s]) <= largest[s] + 9 * 4 + 1e-6
    assert mixing.mix_sizes(docs_of(spark, [])).count() == 0 and mixing.mix(docs_of(spark, [])).count() == 0


def test_mixing_levels(spark):
    rows = spark.createDataFrame([(i, 0, "s", 1 + i % 7, 1, 1.3) for i in range(700)], "id long, rk long, src string, size long, m long, f double")
    got = mixing.copies(rows, fan=8).collect()
    assert len(got) == 700 and {r["total"] for r in got} == {1, 2}
    assert abs(sum(r["total"] * r["size"] for r in got) - 1.3 * sum(r["size"] for r in got)) <= 7


# --- 6 ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "wave"), [(512, 64), (3, 2)])
def test_knn(spark, block, wave):
    rng = np.random.default_rng(4)
    v = {i: [float(x) for x in rng.normal(size=8).astype("float32") / 3] for i in range(0, 900, 3)}
    for i in range(1, 200, 3):
        v[i] = v[(i * 7) % 300 // 3 * 3]  # ties
    bad = [(10001, None), (10002, [1.0, None]), (10003, [float("nan")]), (10004, [float("inf")] * 8), (None, [1.0] * 8), (10100, [0.5, 0.25]), (10200, [])]
    rows = [*v.items(), *bad, (3, v[3])]
    df = spark.createDataFrame([(i, e, 0, 1) for i, e in rows], "vec_id long, embedding array<float>, label int, id int")
    got = [tuple(r) for r in knn.top_k(df, df["vec_id"] % 100 == 0, n_pivots=7, block=block, wave=wave, chunk_rows=100).collect()]
    ok = [(i, [math.floor(1024 * x) for x in e] + [0] * (8 - len(e))) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, e in ok:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in ok if i != q)[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert Counter(got) == Counter(want)
    assert knn.top_k(df.limit(0), df["vec_id"] % 100 == 0).count() == 0


def test_knn_of_large_components(spark):
    """Scores past 2^53 are whole, and what can't fit into a long is refused."""
    rng = random.Random(4)
    v = {i: [float(rng.randrange(-(1 << 18), 1 << 18)) for _ in range(64)] for i in range(60)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = [tuple(r) for r in knn.top_k(df, df["vec_id"] % 10 == 0, n_pivots=5).collect()]
    want = []
    for q in range(0, 60, 10):
        best = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want) and max(abs(s) for *_, s in want) > 1 << 53
    with pytest.raises(ValueError, match="too large"):
        knn.top_k(spark.createDataFrame([(0, [3e6])], "vec_id long, embedding array<double>"), F.lit(True))


def test_knn_sends_little_of_clusters(spark):
    """Of 12 tight clusters a group gets little more than its own."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    centers /= np.sqrt((centers**2).sum(1))[:, None]
    v = [(i, [float(x) for x in centers[i % 12] + rng.normal(size=16) * 0.01]) for i in range(3000)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    p = knn.plan(df, df["vec_id"] % 7 == 0, 10, "vec_id", "embedding", 1024, 64, 64, 20_000)
    numbers = [r["group"] for r in p.groups.select("group").collect()]
    assert len(numbers) > 5 and p.sent(numbers).count() < 0.25 * len(numbers) * len(v)


# --- 7 ----------------------------------------------------------------------------------------------------------


def katz_by_hand(rows):
    tokens = lambda t: [*(w.lower() if w.isascii() else w for w in WORD.findall(t or "")), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    one, two = Counter(), defaultdict(Counter)
    for d, t in rows:
        if not held(d):
            for a, b in zip(["<s>", *tokens(t)], tokens(t), strict=False):
                one[b] += 1
                two[a][b] += 1
    types = lambda counts: [sum(c == r for c in counts) for r in range(1, katz.TOP + 2)]
    n = sum(one.values())
    d1, d2 = katz.discounts(types(one.values())), katz.discounts(types([c for x in two.values() for c in x.values()]))

    def model(d, counts):
        kept = {w: d[c] * c if c <= katz.TOP else c for w, c in counts.items()}
        total = sum(counts.values())
        if sum(kept.values()) > total * (1 - 1e-12):
            return {w: c / (total + 1) for w, c in counts.items()}, 1 / (total + 1)
        return {w: x / total for w, x in kept.items()}, 1 - sum(kept.values()) / total

    uni, unknown = model(d1, one) if n else ({}, 1.0)

    def p(h, w):
        if h not in two:
            return uni.get(w, unknown)
        seen, left = model(d2, two[h])
        return seen[w] if w in seen else left / (1 - sum(uni[x] for x in seen)) * uni.get(w, unknown)

    out = Counter()
    for d, t in rows:
        ws = tokens(t)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1))) for w in ws)
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *ws], ws, strict=False))
        out[d, held(d), len(ws), sum(w in one for w in ws), n, round(base, 6), round(score, 6)] += 1
    for h in [*list(two)[:20], "nobody"]:
        assert math.isclose(sum(p(h, w) for w in one) + p(h, "never seen"), 1, rel_tol=1e-9)
    return out


def test_katz(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(0, 60), rng.choice([30, 400]))) for i in range(150)] + [(900, None), (901, ""), (902, "W1 w1 Ä w2"), (None, "w1 w2"), (3, "w1 w2 w3"), (3, "w1 w2 w3"), (7, words(rng, 4000, 90))]
    want = katz_by_hand(rows)
    for kw in ({}, {"chunk_tokens": 500, "part": 50}):
        got = katz.katz(docs_of(spark, rows).withColumnsRenamed({"lang": "chunk", "source": "train"}), **kw)
        assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        assert Counter((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got.collect()) == want
    assert katz.katz(docs_of(spark, [])).count() == 0
    alone = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    only = katz.katz(docs_of(spark, [(i, "a b") for i in alone])).collect()
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in only] == [(0, 0, 0.0)] * 3


# --- 8 ----------------------------------------------------------------------------------------------------------


def test_chat(spark):
    rng = random.Random(2)
    odd = ["</s>", "[INST] x", "\\0 \\1\\", "a\nb", "", None, "[/INST]<s>]", "é[", "plain words"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool[]", None]), rng.choice(odd)) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (90, None, "user", "first"), (90, 0, "assistant", "r" * 100000), (91, 0, "user", "same"), (91, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, example int")
    examples = chat.chat_examples(df)
    got = {r["conv_id"]: r for r in chat.digest(examples).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t is not None, t or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    replies = Counter(r[0] for r in rows if r[2] == "assistant")
    made = Counter(r["conv_id"] for r in examples.where("loss_start > 0 OR loss_length > 0").collect())
    assert all(made[c] >= n for c, n in replies.items())
    for r in examples.collect():
        assert r["loss_start"] + r["loss_length"] <= len(r["formatted"])
    assert chat.digest(chat.chat_examples(df.limit(0))).count() == 0


# --- 9 ----------------------------------------------------------------------------------------------------------


def test_fold():
    assert toxicity.fold("You 1D1OT! stupіd S​traße été pa$$word") .split() == ["you", "idiot", "ldlot", "stupid", "strasse", "ete", "password"]
    assert toxicity.fold("") == "  "


def naive_density(lexicon, text):
    words_, total = toxicity.fold(text).split(), 0.0
    for k, w in enumerate(words_):
        found = [weight for entry, weight in lexicon.weights.items() if w.startswith(entry)]
        near = {f"{words_[k - 1] if k else ''} {w}", f"{w} {words_[k + 1] if k + 1 < len(words_) else ''}"}
        if found and not near & lexicon.exceptions:
            total += max(found)
    return 100 * total / max(10, len(words_))


def test_density():
    """The automaton against the naive matcher, with entries that begin each other and phrases that excuse a word."""
    rng = random.Random(5)
    vocabulary = ["grub", "grubber", "grubbing", "shrew", "vile", "vilefoe", "n1ce", "the", "gr\u0443b", "VILE!", "a"]
    lexicon = toxicity.Lexicon({"grub": 2.0, "grubber": 3.5, "vile": 1.0, "vilef": 4.0}, frozenset({"grubber shrew", "the vile", "grub grub"}), 2.0, -3.0)
    automaton = lexicon.automaton()
    for n in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25)))
        assert lexicon.density(toxicity.fold(text), automaton) == pytest.approx(naive_density(lexicon, text)), text


def test_small_lexicon():
    """Few labelled rows still give a lexicon."""
    rng = random.Random(1)
    toxic = [f"{words(rng, 12)} vilefoe {words(rng, 5)}" for _ in range(8)]
    lexicon = toxicity.learn(toxic, [words(rng, 17) for _ in range(40)])
    assert any("vilefoe".startswith(e) for e in lexicon.weights)


def test_lexicon_is_learned_in_a_task(spark, monkeypatch):
    """The driver gets the lexicon, not the texts; it is the one that all rows in the order of their hashes give."""
    rng = random.Random(5)
    rows = [(i, f"{words(rng, 12)} {'vilefoe' if i % 3 == 0 else 'kind'} {words(rng, 9)}", "a") for i in range(60)]
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    order = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    of = {i: t for i, t, _ in rows}
    want = toxicity.learn([of[i] for i in order if i % 3 == 0], [of[i] for i in order if i % 3])
    assert want.weights
    monkeypatch.setattr(toxicity, "learn", None)  # the driver's own; a task imports the module's
    assert toxicity.fit(docs, labels) == want
    assert toxicity.fit(docs, labels.limit(0)) == toxicity.Lexicon()


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["vilefoe", "grubber", "nastling"]
    rows, labels = [], []
    for i in range(600):
        t = words(rng, rng.randrange(8, 60)).split()
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                w = rng.choice(bad)
                t.insert(rng.randrange(len(t)), rng.choice([w, w.upper() + "!", w.replace("e", "3"), w + "s"]))
        elif i % 9 == 0:
            t.insert(len(t) // 2, "grubber shrew")
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "vilefoe " * 50_000), (None, "vilefoe grubber nastling"), rows[4]]
    lab = spark.createDataFrame([*labels, (900, 1, 0), (901, 1, None), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_all(docs_of(spark, rows).withColumnsRenamed({"lang": "score", "source": "_h"}), lab).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    score = {r["doc_id"]: r["predicted"] for r in got}
    assert score[900] == score[901] == 0 and score[902] == score[None] == 1
    kept = toxicity.reject(docs_of(spark, rows), lab)
    assert kept.columns == docs_of(spark, []).columns and kept.count() == sum(1 - r["predicted"] for r in got)
    assert {r["score"] for r in toxicity.score_all(docs_of(spark, rows[:3]), lab.limit(0)).collect()} == {0.0}
    # the score against a matcher that tries every entry on every word
    lexicon = toxicity.fit(docs_of(spark, rows), lab.where(~toxicity.held_out(lab["doc_id"])))
    assert lexicon.weights
    for r, (_, text) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(rows, key=lambda r: str(r[0])), strict=True):
        assert r["score"] == pytest.approx(lexicon.score(naive_density(lexicon, text or "")), abs=1e-12)
    assert toxicity.score_all(docs_of(spark, []), lab).count() == 0


# --- 10 ---------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rng = random.Random(8)
    phrase = {tuple(p.split()): label for p, label in licenses.PHRASES}
    parts = ["MIT License", "mit-license", "Apache  LICENSE", "General Public License", "general public mit license", "of the", "mit", "license", "x" * 50, "ÄMIT license", "general public license license"]
    rows = [(i, " ".join(rng.choice([*parts, f"w{rng.randrange(9)}"]) for _ in range(rng.randrange(0, 30)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "mit license " * 3000), (None, "mit license"), rows[1], rows[1], (203, "Licensed under CC BY-NC 4.0."), (204, "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and its associated documentation files"), (205, "of the the and of this software by the")]
    got = licenses.scan(docs_of(spark, rows).withColumnsRenamed({"lang": "words", "source": "label", "n_chars": "h"}))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = Counter()
    for d, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, label) for p, label in phrase.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        places = [i for i, _ in at]
        want[d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    rows_got = got.collect()
    assert Counter(tuple(r)[:6] for r in rows_got) == want
    for r in rows_got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in rows_got}
    assert labels[203] == "cc-by-nc" and labels[204] == "mit" and labels[205] == "" == labels[200]
    assert licenses.scan(docs_of(spark, [])).count() == 0


# --- all --------------------------------------------------------------------------------------------------------


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_near_copies_of_a_changed_base(spark):
    """Many changed copies of one text, few of them alike, against all pairs; the candidates stay well below all pairs."""
    rng = random.Random(12)
    base = words(rng, 150, 5000).split()
    texts = []
    for k in range(300):
        x = list(base)
        for _ in range(rng.randrange(1, 9)):
            x[rng.randrange(len(x))] = f"y{rng.randrange(10**6)}"
        if k % 10 == 0 and k:
            x = texts[rng.randrange(k)].split()
            x[rng.randrange(len(x))] = "once"
        texts.append(" ".join(x))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    n = range(len(texts))
    links = [(a, b) for a in n for b in n if a < b and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])]
    root = classes_of(n, links)
    assert 20 < len(set(root.values())) < 290
    for sample in (1, 8):
        got = near_copies.one_of_each(docs_of(spark, list(enumerate(texts))), group=3, sample=sample)
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """The stage's first classes: fingerprints of the sets that meet in simhash's blocks, checked exactly. What they leave
    is found by the join alone."""
    import corpus_pipeline

    rng = random.Random(21)
    texts = []
    for _ in range(15):
        base = words(rng, 400, 5000).split()
        for changes in (0, 1, 1, 6, 7, 30):
            x = list(base)
            for _ in range(changes):
                x[rng.randrange(len(x))] = f"y{rng.randrange(9999)}"
            texts.append(" ".join(x))
    texts += [texts[0], "", None]
    sets = [near_copies.shingles(t) for t in texts]
    pairs = [near_copies.shingles(t, 2) for t in texts]
    bits = [simhash.majority(s.view(np.uint64)) for s in pairs]
    for s, b in zip(pairs[:3], bits[:3], strict=True):
        assert b == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s.view(np.uint64)) > len(s))
    alike = lambda a, b: 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
    n = range(len(texts))
    links = [(a, b) for a in n for b in n if a < b and alike(sets[a], sets[b])]
    first = classes_of(n, [(a, b) for a, b in links if (bits[a] ^ bits[b]).bit_count() <= 5])
    whole = classes_of(n, links)
    assert len(set(whole.values())) < len(set(first.values())) < len(texts) - 3
    df = docs_of(spark, list(enumerate(texts)))
    ids = lambda: sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, df, "").collect())
    assert ids() == sorted(set(whole.values()))
    monkeypatch.setattr(near_copies, "set_links", lambda *a, known, **b: known)
    assert ids() == sorted(set(first.values()))


def test_katz_memory_of_a_chunk():
    """What a task holds at once for the bigrams of a chunk, in bytes for each token."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    n, size = 20_000, 300_000
    tokens = np.concatenate([np.arange(n), (n * rng.random(size - n) ** 3).astype(np.int64)])
    lengths = [size // 2, 1, size - size // 2 - 1]
    packed = {"lengths": np.array(lengths), "train": np.array([True, True, False]), "tokens": tokens}
    chunk = pd.DataFrame([{k: katz.pack(v) for k, v in packed.items()}])
    answers = pd.DataFrame({"bucket": [0], "numbers": [katz.pack(np.arange(1, n + 1))], "counts": [katz.pack(np.bincount(tokens))]})
    tracemalloc.start()
    katz._bigram_requests(8)((0,), chunk, answers)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * size
    g = katz.Bigrams(chunk.iloc[0], answers)
    before = np.concatenate([[n], tokens[:-1]])
    before[[size // 2, size // 2 + 1]] = n
    assert (g.contexts[g.of[g.at]] == before).all() and (g.word[g.at] == tokens).all()
    assert len(g.word) == len(set(zip(before.tolist(), tokens.tolist(), strict=True))) == g.runs.sum()


def test_words_are_hashed_without_imports(monkeypatch):
    """A new word costs its hash, not an import's look-up as well; and shingles come as np.unique would give them."""
    import builtins

    import numpy as np

    from rasterloom.llm import near_copies

    known, seen, real = near_copies.Words(), [], builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (seen.append(name), real(name, *a, **k))[1])
    got = near_copies.word_hashes(" ".join(f"w{i % 300}" for i in range(900)), known)
    monkeypatch.undo()
    assert "xxhash" not in seen and len(known) == 300
    grams = near_copies.hashed(got, 5)
    assert len(grams) == 300 and (np.unique(grams.view(np.uint64)).view(np.int64) == grams).all()
