"""What a Python worker holds while it packs, and goes on holding beside the stages that follow."""

import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from wayfare.llm import packing
from wayfare.llm.queries import tokenizer_file


def cutter(monkeypatch, **options):
    """The function that ``pack`` runs over batches of ids."""
    found = []
    rows = SimpleNamespace(select=lambda *_: rows, mapInArrow=lambda f, _: found.append(f))
    monkeypatch.setattr(packing, "tokenize", lambda *_, **__: None)
    monkeypatch.setattr(packing, "with_offsets", lambda _: rows)
    packing.pack(SimpleNamespace(dtypes=[("doc_id", "bigint")]), "", **options)
    return found[0]


def test_cutting_does_not_copy_the_ids(monkeypatch):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 3000, 6000)
    ends = np.cumsum(n)
    ids = rng.integers(0, 50_000, ends[-1]).astype("<u4").tobytes()
    at = [ids[(e - k) * 4 : e * 4] for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(n))), pa.array(ends - n + 700), pa.array(n), pa.array(at, pa.binary())], names=["doc_id", "begin", "n", "ids"])
    for given in (batch, batch.slice(1234)):
        run = cutter(monkeypatch)
        tracemalloc.start()
        for _ in run(iter([given])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < len(ids) / 8
    for given, skipped in ((batch, 0), (batch.slice(1234), 1234), (batch.slice(0, 0), 0)):
        whole = {}
        for out in cutter(monkeypatch)(iter([given])):
            for r in out.to_pylist():
                assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
                assert r["offset"] + r["length"] <= 1024
                assert r["sequence_id"] * 1024 + r["offset"] == 700 + ends[r["doc_id"]] - n[r["doc_id"]] + r["start"]
                assert r["start"] * 4 == len(whole.setdefault(r["doc_id"], b""))
                whole[r["doc_id"]] += r["ids"]
        assert whole == {d: at[d] for d in range(skipped, skipped + given.num_rows)}
    plain = list(cutter(monkeypatch, with_ids=False)(iter([batch])))
    assert "ids" not in plain[0].schema.names and sum(x.column("length").to_numpy().sum() for x in plain) == ends[-1]


def test_a_worker_builds_its_encoder_once():
    assert packing.byte_bpe_encoder(tokenizer_file()) is packing.byte_bpe_encoder(tokenizer_file())
