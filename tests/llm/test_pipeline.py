import random

import corpus_pipeline as cp
from tests.conftest import SF_SMALL
from tests.llm.brute import components, words


def prose(rng, n):
    return " ".join(f"t{rng.randrange(5000)}" for _ in range(n))


def test_planted_cases(spark, scratch):
    rng = random.Random(9)
    passage, item = prose(rng, 60), prose(rng, 25)
    rows = [(i, prose(rng, rng.randrange(20, 120)), "en", f"s{i % 5}") for i in range(60)]
    base = rows[0][1]
    near = base.split()
    near[3] = "other"
    rows += [(100, base, "en", "s1"), (101, prose(rng, 40) + " " + passage, "de", "s1"), (102, passage + " " + prose(rng, 40), "de", "s2"),
             (103, prose(rng, 30) + " " + item + " end", "fr", "s3"), (104, None, None, None), (105, "", "en", "s4"), (106, " ".join(near) if len(near) > 80 else base, "en", "s2"), (None, "x y", "en", "s")]
    toxic = [(200 + i, prose(rng, 30) + " vileword vileword vileword " + prose(rng, 5), "en", "s6") for i in range(40)]
    rows += toxic
    docs = spark.createDataFrame([(*r[:2], *r[2:], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(r in toxic)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    at, kept = docs, []
    for name, step in cp.STAGES[:-1]:
        at = cp.stage(step(spark, at, scratch), name)
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        kept.append({r.doc_id: r.text for r in at.collect()})
    clean = {r[0] for r in rows if r not in toxic}
    assert set(kept[0]) == clean
    groups = components({k: v for k, v in kept[0].items() if k is not None}, 5, 80)
    assert set(kept[1]) == {d for d, (_, c) in groups.items() if d == c} | {None}
    assert kept[2][101] == kept[1][101] and passage not in kept[2][102] and len(words(kept[2][102])) == 40
    assert {d: t for d, t in kept[2].items() if d != 102} == {d: t for d, t in kept[1].items() if d != 102}
    assert set(kept[3]) == set(kept[2]) - {103}
    packed = cp.run(spark, scratch).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def test_empty_documents(spark, scratch):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{scratch}/{t}.parquet")
    assert cp.run(spark, scratch).count() == 0


def test_registered_queries_return_their_columns(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    names = [n for n in queries if n.startswith("op")]
    assert len(names) == 10 and "pipeline" in queries
    contract = {"op1": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op3": ["doc_id", "n_shingles", "component_id"],
                "op4": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op5": ["doc_id", "held_out", "score", "predicted"],
                "op6": ["query_id", "rank", "vec_id", "score"], "op7": ["page_id", "url", "text", "n_chars"], "op10": ["doc_id", "n_words", "n_removed", "kept_sha256"]}
    for name in names:
        df = queries[name](spark, SF_SMALL)
        assert set(contract.get(name.split("_")[0], [])) <= set(df.columns)
