"""op4 on documents that hold the tokenizer's special tokens as text."""

import zlib

import numpy as np
import pytest

from quern.llm import queries


def test_special_tokens(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public.path(queries.TOKENIZER))
    texts = ["abc <|endoftext|> def", "<|startoftext|>Abc.<|endoftext|>, def <|endoftext|>", "plain words.", None, "<|ENDOFTEXT|> <|endoftext|>\n<|startoftext|>.", "a\x1c<|endoftext|> b", " <|startoftext|> <|endoftext| >"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*one.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert one.encode(texts[0], add_special_tokens=False).ids == [5334, 49407, 11649]
    assert sorted(tuple(r) for r in queries.op4_huffman_ids(spark, str(tmp_path)).collect()) == want


def test_pieces_and_whole_texts():
    """Ids of odd texts are the library's, with words taken apart and, for a file of another form, without."""
    import json
    import random

    import pyarrow as pa

    from quern.llm import huffman

    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(queries.TOKENIZER)
    one, each = Tokenizer.from_file(path), huffman.Encoder(path)
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    assert each.apart and not huffman.Encoder.known(form | {"normalizer": None}) and not huffman.Encoder.known(form | {"post_processor": {"type": "X"}})
    rng = random.Random(3)
    signs = [*"abcXYZ  '\n\t09.,!?-_#<|>é中  \x1c\x0b\x85ΣßİÉ", "<|endoftext|>", "<|startoftext|>", "don't", "'s", "</w>", " 12 ", "***"]
    texts = [None, "", " ", *["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(2000)]]
    want = [[*one.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for apart in (True, False):
        each.apart = apart
        ids, n = each(pa.array(texts), 2)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
