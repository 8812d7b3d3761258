"""Every stage of the pipeline on whole sf0.01 against a plain form of it, and its last rows."""

import struct
import sys
import zlib
from collections import defaultdict
from pathlib import Path

from tokenizers import Tokenizer
from wayfare.llm import quality
from wayfare.llm.queries import tokenizer_file

from . import brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages_and_rows(spark, data, tmp_path):
    import corpus_pipeline

    folder = f"{data}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r["doc_id"] for r in quality.score(docs, labels).collect() if r["predicted"]}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {}
    want["quality"] = {d: t for d, t in texts.items() if d in good}
    want["line_dedup"] = {d: kept for d, _, _, kept in brute.kept_lines(list(want["quality"].items()))}
    near = brute.near(list(want["line_dedup"].items()))
    want["near_dedup"] = {d: t for d, t in want["line_dedup"].items() if near[d][0] == d}
    held = {d for d, _ in brute.templates(list(want["near_dedup"].items()), items)}
    want["decontamination"] = {d: t for d, t in want["near_dedup"].items() if d not in held}
    before = len(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        assert docs.columns == columns and len(rows) < before or name == "line_dedup"
        assert {r["doc_id"]: r["text"] for r in rows} == want[name] and len(rows) == len(want[name]), name
        assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
        before = len(rows)
    tok = Tokenizer.from_file(tokenizer_file())
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in want["decontamination"].items()}
    parts = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        parts[r["doc_id"]].append((r["start"], r["length"]))
    assert {d: brute.tiles(p) for d, p in parts.items()} == {d: len(x) for d, x in ids.items()}
