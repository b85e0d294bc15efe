import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from newsloom.llm import token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def text_hash(text):
    return 42 if text is None else int(np.uint64(xxhash.xxh64(text.encode(), seed=42).intdigest()).astype(np.int64))


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_chunks_encode_as_the_whole_text(whole):
    rng = random.Random(2)
    pieces = [" ", "\n", "  ", "\t", "\x1f", "\x85", " ", "　", " ", ",", ".", "...", "'s", "'ll", "don't", "Word", "wörter", "漢字", "。", "12", "3.5", "×", "\U0001f600", "<|endoftext|>", "|", "\x1c", "ﬁ", "a", "é", "\r\n", "ß,", "٣."]
    texts = [None, "", *pieces, *("".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(4000))]
    assert split(*token_files.encode(pa.array(texts), VOCABULARY)) == [whole(t) for t in texts]


def test_long_text_and_small_memory(whole, monkeypatch):
    words = " ".join(f"word{i % 5000}" for i in range(200_000))
    text = f"{words}. {'x' * 20_000}\n\n{words}"
    monkeypatch.setattr(token_files, "GROUP_CHARS", 1000)
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    for column in ([text], ["a b", text, "a, b", None, "b a"]):
        assert split(*token_files.encode(pa.array(column), VOCABULARY)) == [whole(t) for t in column]


def test_text_of_20_mb():
    ids, counts = token_files.encode(pa.array(["some words, again and again. " * 700_000]), VOCABULARY)
    assert len(ids) == counts[0] > 4_000_000 and ids[-1] == 2


def test_files(spark, nasty, whole, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write(nasty, folder, VOCABULARY, shards=3).orderBy("shard").collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in nasty.collect()), key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1])))
    flat = np.concatenate([np.fromfile(f"{tmp_path}/tokens/{m['tokens_file']}", "<u2") for m in manifest])
    assert flat.tolist() == [i for _, t in rows for i in whole(t)]
    assert len(manifest) > 1 and manifest[-1]["first_token"] + manifest[-1]["n_tokens"] == len(flat)
    starts = np.cumsum([0] + [len(whole(t)) for _, t in rows])
    read = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in read] == [(d, s, len(whole(t)), whole(t)) for (d, t), s in zip(rows, starts, strict=False)]
    for m in manifest:
        offsets = np.fromfile(f"{tmp_path}/tokens/{m['offsets_file']}", "<i8")
        assert len(offsets) == m["n_docs"] + 1 and offsets[0] == m["first_token"]


def test_round_trip(nasty, nothing, whole):
    want = sorted((repr(r["doc_id"]), zlib.crc32(np.array(whole(r["text"]), "<u4"))) for r in nasty.collect())
    assert sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in token_files.round_trip(nasty).collect()) == want
    assert token_files.round_trip(nothing).count() == 0


def test_wide_ids(nasty, tmp_path):
    manifest = token_files.write(nasty, f"file://{tmp_path}/wide", VOCABULARY, end_id=70_000).collect()
    ids = np.fromfile(f"{tmp_path}/wide/{manifest[0]['tokens_file']}", "<u4")
    assert {m["kind"] for m in manifest} == {"<u4"} and ids[-1] == 70_000


def test_damaged_file_is_noticed(spark, nasty, tmp_path):
    manifest = token_files.write(nasty, f"file://{tmp_path}/hurt", VOCABULARY).first()
    with open(f"{tmp_path}/hurt/{manifest['tokens_file']}", "ab") as file:
        file.write(b"\0\0")
    with pytest.raises(Exception, match="manifest"):
        token_files.read(spark, f"file://{tmp_path}/hurt").collect()
