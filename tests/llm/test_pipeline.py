"""The stages as a chain, against brute force."""

import random
from collections import Counter

import corpus_pipeline
from rasterloom.llm import decontamination, toxicity

from test_operators import WORD, classes_of, docs_of, edits_inside, lines_without, naive_density, words


def tables(spark, folder, rows, labels, items):
    docs_of(spark, rows).withColumnsRenamed({"lang": "key", "n_chars": "root"}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def grams(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_chain(spark, tmp_path):
    rng = random.Random(7)
    rows, labels, items = [], [], [(i, words(rng, 14, 4000)) for i in range(5)]
    for i in range(140):
        text = "\n".join(words(rng, rng.randrange(6, 30), 3000) for _ in range(rng.randrange(1, 4)))
        toxic = i % 5 == 1
        if toxic:
            text = f"{text} vilefoe {words(rng, 3)} gr\u0443bber and v1lefoe"
        labels.append((i, 1, int(toxic)))
        rows.append((i, text, rng.choice(["a", "b", "c", None])))
    for k in range(12):  # near and exact copies, repeated lines, items within texts
        source = rows[2 + 10 * k][1].split(" ")
        source[rng.randrange(len(source))] = "changed"
        rows += [(200 + k, " ".join(source), "b"), (300 + k, rows[3 + 10 * k][1], "a"), (400 + k, f"{words(rng, 20, 3000)}\n{rows[4 + 10 * k][1].split(chr(10))[0]}", "c"), (500 + k, f"{words(rng, 9, 3000)} {items[k % 5][1]} {words(rng, 5, 3000)}", "a")]
    rows += [(600, None, "a"), (601, "", None), (602, " \n ", "a"), (None, "no id but a text of its own", "a"), rows[0]]
    sf_dir = tables(spark, tmp_path, rows, labels, items)

    lexicon = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where(~toxicity.held_out(__import__("pyspark").sql.functions.col("doc_id"))))
    kept = [(d, t) for d, t, _ in rows if lexicon.score(naive_density(lexicon, t or "")) < 0.5]
    assert len(rows) - len(kept) > 15
    of = lines_without(kept, 1)
    kept = [(d, of[d, t or ""] if t else t) for d, t in kept]
    sets = [grams(t) for _, t in kept]
    alike = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    n = range(len(kept))
    root = classes_of(n, [(i, j) for i in n for j in n if i < j and alike(sets[i], sets[j])])
    least = {}
    for i in n:
        key = (kept[i][0] is None, kept[i][0] or 0)
        least[root[i]] = min(least.get(root[i], (key, i)), (key, i))
    kept = [kept[i] for _, i in least.values()]
    normal = [(i, decontamination.normalised(x)) for i, x in items]
    clean = [(d, t) for d, t in kept if not any(edits_inside(x, decontamination.normalised(t)) <= len(x) // 10 for _, x in normal)]
    assert len(kept) > len(clean)

    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "key", "source", "root"]
    got = out.collect()
    assert {(r["doc_id"], r["text"] or "") for r in got} <= {(d, t or "") for d, t in clean}
    taken = Counter((r["doc_id"], r["text"] or "") for r in got)
    source = {d: s for d, _, s in rows}
    size, mixed = Counter(), Counter()
    for d, t in clean:
        size[source[d]] += len(WORD.findall(t or ""))
        mixed[source[d]] += taken[d, t or ""] * len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total = sum(size.values())
    share = {s: total * weight[s] / sum(weight.values()) for s in order}
    if all(share[s] < 3 * size[s] for s in order):
        assert all(abs(mixed[s] - share[s]) <= 100 for s in order)
    assert max(taken.values()) <= 3
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) == Counter((r["doc_id"], r["text"]) for r in got)


def test_empty_chain(spark, tmp_path):
    sf_dir = tables(spark, tmp_path / "none", [], [], [])
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "key", "source", "root"]
    sf_dir = tables(spark, tmp_path / "nulls", [(None, None, None), (None, "", None), (1, "", "a")], [(1, None, None)], [(None, None)])
    assert corpus_pipeline.run(spark, sf_dir).count() == 1  # all of them are copies of the empty text


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "mixing"]


def test_line_stage_runs_small_plans(spark, monkeypatch):
    """Near copies that meet in many rounds: no table of the stage is made by one plan of all rounds' joins."""
    from rasterloom.llm import lines

    joins, save = {}, lines.saved

    def noted(df, name, **more):
        joins[name] = max(joins.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return save(df, name, **more)

    monkeypatch.setattr(lines, "saved", noted)
    rows = [(n, f"one of many near copies says w{n:06d} in the middle of its only line", "en", "s", 1) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.dedup_lines(spark, docs, "").where("text != ''").count() == 1
    assert max(joins.values()) <= 6, joins
