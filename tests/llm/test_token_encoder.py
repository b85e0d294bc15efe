"""The encoder asks for ids alone, without offsets, and gives the ids of whole texts also when its memory starts anew."""

import pyarrow as pa
import public_tokenizers

from newsloom.llm import token_files


def test_ids_without_offsets(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    encoder = token_files._Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder._batch.__name__ == "encode_batch_fast"
    for texts in (["one two, three.", "", "é 世界 one"], ["two two\n three 🙂", " <s> "], ["one two, three."]):
        ids, counts = encoder(pa.array(texts, pa.large_string()))
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
