import zlib

import corpus_pipeline
from colophon.llm import queries


def write(spark, folder, table, marks):
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_on_a_small_table(spark, tmp_path):
    from tests.llm.test_classifiers import corpus
    from tests.llm.test_lines import by_hand

    table, marks = corpus(300)
    copies = [(1000 + i, table[i][1], "s") for i in range(1, 40, 5)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in table + copies] + [(5000, None, None, None, None)]
    write(spark, tmp_path, rows, marks)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = df
        if name != "best_fit_packing":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = sorted((r.doc_id, r.text) for r in out["toxicity"].collect())
    toxic = {i for i, _, t in marks if t}
    assert sum(i in toxic for i, _ in clean) <= 3 and 5000 in {i for i, _ in clean}
    filled = [(i, t) for i, t in clean if t is not None]
    assert [r.text for r in out["line_dedup"].orderBy("doc_id").collect() if r.text is not None] == by_hand([t for _, t in filled])
    assert out["mixing_sources"].count() <= out["simhash_near_dedup"].count() <= len(clean)
    packed = {r.doc_id for r in out["best_fit_packing"].collect()}
    assert packed == {r.doc_id for r in out["mixing_sources"].collect()}


def test_run_equals_a_chain_by_hand(spark, tmp_path):
    from colophon.llm import simhash, toxicity
    from colophon.llm.tokens import encoder
    from tests.llm.test_classifiers import corpus
    from tests.llm.test_lines import by_hand
    from tests.llm.test_simhash import groups_by_hand

    table, marks = corpus(240)
    sources = {i: "hot" if i % 3 else f"s{i % 4}" for i, _, _ in table} | {239: "alone"}
    rows = [(i, t, "en", sources[i], len(t)) for i, t, _ in table] + [(2000 + i, table[i][1], "en", None, 1) for i in range(1, 30, 7)] + [(3000, table[1][1] + " more", "en", "hot", 1), (3001, "", "en", "hot", 0), (3002, "long " * 3000, "en", "hot", 1)]
    write(spark, tmp_path, rows, marks)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scorer = toxicity.Scorer(*toxicity.train(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    clean = sorted((i, t) for i, t, *_ in rows if scorer.score(t) < 0.7)
    lines = list(zip([i for i, _ in clean], by_hand([t for _, t in clean]), strict=True))
    prints = {i: simhash.fingerprint(t) for i, t in lines}
    groups = groups_by_hand(set(prints.values()))
    kept = {min(i for i in prints if groups[prints[i]] == g) for g in set(groups.values())}
    texts = {i: t for i, t in lines if i in kept}
    pieces = {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) for i, rs in _by(corpus_pipeline.run(spark, str(tmp_path)).collect(), "doc_id").items()}
    ids_of = encoder(queries.vocabulary()).ids
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = [*ids_of(text), 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        assert pieces[i] == [(k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _by(rows, name):
    out = {}
    for r in rows:
        out.setdefault(r[name], []).append(r)
    return out


def test_sequences_are_gapless_and_sources_stay_in_step(spark, tmp_path):
    from colophon.llm import mixing

    rows = [(i, f"word{i} " * (i % 90 + 1), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(400)]
    write(spark, tmp_path, rows, [])
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    mixed = [r.doc_id for r in corpus_pipeline.mixing_stage(spark, frame, str(tmp_path)).collect()]
    slots = {r.doc_id: r.slot for r in mixing.schedule(frame).collect()}
    assert mixed == sorted(slots, key=lambda i: (slots[i], i)) and len(mixed) == 400
    packed = corpus_pipeline.packing_stage(spark, frame, str(tmp_path)).collect()
    for rs in _by(packed, "sequence_id").values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{i}" for i in range(1, 14))
