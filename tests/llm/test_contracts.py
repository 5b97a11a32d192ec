"""Columns and their kinds, as the queries' contracts name them."""

from pathlib import Path

import pytest

from contiguum.llm import queries

DATA = Path("/root/testdata/sf0.001")
KINDS = {"long": "bigint"}
CONTRACTS = {
    "op1": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    "op2": "vec_id long, n_links long, component_id long, kept boolean",
    "op3": "query_id long, rank int, vec_id long, score double",
    "op4": "doc_id long, held_out boolean, score double, predicted int",
    "op5": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
    "op6": "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    "op7": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op8": "page_id long, host string, path string, rule string, verdict string",
    "op9": "doc_id long, n_shingles long, component_id long",
    "op10": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    "op11": "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    "op12": "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13": "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("op", CONTRACTS)
def test_columns(spark, op):
    pytest.importorskip("public_tokenizers")
    name = next(n for n in queries.queries() if n.startswith(f"{op}_"))
    got = dict(queries.queries()[name](spark, str(DATA)).dtypes)
    want = dict(f.split() for f in CONTRACTS[op].split(", "))
    assert {c: got.get(c) for c in want} == {c: KINDS.get(k, k) for c, k in want.items()}
