import random

import corpus_pipeline
from shelfmark.llm import bpe, exact_dedup, near_dedup

from .test_near_dedup import brute, changed


def corpus():
    rng = random.Random(11)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows, labels = [], []

    def add(words):
        rows.append((len(rows), words if isinstance(words, str) or words is None else " ".join(words)))

    for i in range(240):
        words = [rng.choice(voc) for _ in range(rng.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for w in ("zquidiot", "zquscum", "zqutrash"):
                words.insert(rng.randrange(len(words)), w)
        labels.append((len(rows), int(toxic)))
        add(words)
    for i in (1, 2, 3):
        add(rows[i][1].replace(" ", "  ", 3))  # longer copies
        add(rows[i][1])
    long = [rng.choice(voc) for _ in range(150)]
    for _ in range(20):
        add(changed(rng, long, 1))
    add("write to ann.lee@mail.example.com or +1 (017) 555-7713 today")
    add(None)
    add("")
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in kept.collect()})
    toxic = {i for i, t in rows if "zquidiot" in (t or "")}
    assert set(seen[0]) == {i for i, _ in rows} - toxic
    norm = lambda t: "".join((t or "").split())
    groups = {}
    for i, t in seen[0].items():
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    assert set(seen[1]) == {min(g)[1] for g in groups.values()}
    assert set(seen[2]) == {i for i, c in brute(list(seen[1].items()), 80).items() if i == c}
    assert set(seen[3]) == set(seen[2])
    assert any(t == "write to [EMAIL] or [PHONE] today" for t in seen[3].values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    coder = bpe.loaded(bpe.default_vocabulary())
    assert pieces.groupby("doc_id").length.sum().to_dict() == {i: len(coder.encode_batch([t or ""])[0]) + 1 for i, t in seen[3].items()}
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_repeated_rows_stay_once(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, " a", "x"), (3, "b", "x"), (None, "c", "x")], "doc_id long, text string, kept string")
    assert sorted(((r.doc_id or 0), r.text) for r in exact_dedup.kept_rows(docs).collect()) == [(0, "c"), (2, " a"), (3, "b")]
    again = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (3, "b", "x")], "doc_id long, text string, kept string")
    assert sorted(r.doc_id for r in exact_dedup.kept_rows(again).collect()) == [1, 3]


def test_other_texts_of_a_dropped_identifier_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    schema = "doc_id long, text string, kept string"
    for rows, left in [
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(3, a), (5, a), (5, b), (6, b), (5, c), (7, None), (7, c)], None),
        ([(1, a), (2, a)], [(1, a)]),
    ]:
        docs = spark.createDataFrame([(*r, "x") for r in rows], schema)
        for dedup in (exact_dedup, near_dedup):
            out = dedup.kept_rows(docs)
            got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
            assert out.columns == docs.columns
            assert left is None or got == left
            assert sorted(str(t) for _, t in got) == sorted({str(t) for _, t in rows})  # each text once
