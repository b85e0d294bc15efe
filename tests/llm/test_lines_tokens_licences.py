import numpy as np
import pytest

from newsloom.llm import licences, line_dedup, token_counts
from nasty_cases import nasty_texts


def test_lines(nasty, nothing):
    got = {(r["doc_id"], r["n_units"]): r for r in line_dedup.by_document(nasty).collect()}
    assert line_dedup.by_document(nasty).count() == nasty.count()
    twenty = got[20, 4]
    assert (twenty["n_removed"], twenty["removed_chars"], twenty["removed_spans"]) == (2, 27, "14-28,35-48")
    assert got[8, 1]["n_removed"] == 1 and got[9, 1]["n_removed"] == 1 and got[7, 1]["n_removed"] == 0
    assert got[4, 0]["n_removed"] == 0
    cut = line_dedup.remove_lines(nasty)
    assert cut.columns == nasty.columns
    assert cut.filter("doc_id = 20").first()["text"] == "the same line\nother"
    assert line_dedup.by_document(nothing).count() == 0


def test_paragraph_units(spark):
    df = spark.createDataFrame([(2, "a b\nc\n\nd"), (1, "x\n\nA  b\nc")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_spans"] for r in line_dedup.by_document(df, separator="\n\n").collect()}
    assert got == {1: "", 2: "0-5"}


def test_sentence_units_find_passages_inside_lines(spark):
    shared = "The agreed passage has more than eight words in it. And a second sentence of it is just as long as this!"
    df = spark.createDataFrame([(1, f"Own start here. {shared} End."), (2, f"Other words.\n{shared}\nYes. No. Yes."), (3, "Yes. No. Yes."), (4, f"A. {shared.lower()}  Z")], "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup.by_document(df).sort("doc_id").collect()] == [0, 0, 1, 0]
    got = {r["doc_id"]: r for r in line_dedup.by_document(df, sentences=True, min_words=8).collect()}
    assert {k: (r["n_units"], r["n_removed"]) for k, r in got.items()} == {1: (2, 0), 2: (2, 2), 3: (0, 0), 4: (2, 2)}
    assert got[2]["removed_spans"] == "13-64,65-117"
    texts = {r["doc_id"]: r["text"] for r in line_dedup.remove_lines(df, sentences=True, min_words=8).collect()}
    assert texts[1] == df.filter("doc_id = 1").first()["text"] and texts[2] == "Other words.\nYes. No. Yes." and texts[4] == "A.  Z"


def test_a_long_text_is_read_whole(spark):
    body = " ".join(f"Sentence number {k} of the long text has its own words." for k in range(400_000))
    df = spark.createDataFrame([(1, body), (2, body[-5_000:])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.by_document(df, sentences=True, min_words=8).collect()}
    assert len(body) > 20_000_000 and got[1]["n_units"] == 400_000 and got[1]["n_removed"] == 0
    assert got[2]["n_removed"] >= got[2]["n_units"] - 1 > 80


def test_tokens_add_up(nasty, nothing):
    encoding, lengths = token_counts.encoder(token_counts.VOCABULARY)
    for rule in token_counts.RULES:
        rows = token_counts.section_tokens(nasty, rule=rule).collect()
        assert sum(r["n_tokens"] for r in rows) == sum(len(encoding.encode_ordinary(t or "")) for _, t in nasty_texts())
    sections = sorted((r["section"], r["start_char"], r["end_char"]) for r in rows if r["doc_id"] == 20)
    assert sections == [(0, 0, 14), (1, 14, 29), (2, 29, 35), (3, 35, 48)]
    assert [tuple(r)[1:] for r in rows if r["doc_id"] == 5] == [(0, 0, 0, 0, 0)]
    assert token_counts.section_tokens(nothing).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(nasty, rule="none")


def test_crossing_tokens_follow_the_rule():
    ends, edges = np.array([3, 8, 10]), np.array([4, 6, 10])  # the token 3-8 covers 1, 2 and 2 bytes of three sections
    assert token_counts.attribute(ends, edges, "start")[0].tolist() == [0, 0, 2]
    assert token_counts.attribute(ends, edges, "end")[0].tolist() == [0, 2, 2]
    assert token_counts.attribute(ends, edges, "largest")[0].tolist() == [0, 1, 2]
    assert token_counts.attribute(ends, edges, "start")[1].tolist() == [False, True, False]


def test_licences(nasty, nothing):
    got = [r for r in licences.scan(nasty).collect() if r["doc_id"] == 19]
    assert got[0]["licences"] == "MIT,Reserved" and got[0]["n_matches"] >= 3
    assert (got[0]["best_licence"], got[0]["best_dice"], got[0]["best_unit"], got[0]["best_start"], got[0]["best_end"]) == ("MIT", 1.0, "line", 0, 30)
    assert licences.scan(nasty).count() == nasty.count()
    assert licences.scan(nothing).count() == 0


def test_licences_by_brute_force(spark):
    """Every line against every template, without size bounds."""
    lines = [t.replace("the", "a", k % 2) + " x" * (k % 3) for k in range(6) for t in licences.TEMPLATES.values()] + ["of the License", "the the the the"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_matches"] for r in licences.scan(df).collect()}
    sets = [licences.bigrams(t.encode()) for t in licences.TEMPLATES.values()]
    for i, line in enumerate(lines):
        own = licences.bigrams(line.encode())
        assert got[i] == sum(licences.dice(own, s) >= licences.THRESHOLD for s in sets), line


def test_whole_licences_are_found_under_their_own_names(spark):
    """Bodies and headers as published, line by line as in a file, with an owner's line before and code behind."""
    mit = licences._body("MIT").split("\n\n")[2]
    lgpl = "\n".join(x.strip() for x in licences._body("LGPL-2.1").split("\n")[475:479])
    gpl = "\n".join(x.strip() for x in licences._body("GPL-3.0").split("\n")[636:648])
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    isc = licences._body("ISC").split("\n\n")[2]
    agpl = gpl.replace("GNU General", "GNU Affero General")
    cases = [(f"Copyright 2020 Owner\n\n{licences._body(k)}", f"{k} text") for k in licences.BODIES]
    cases += [(gpl, "GPL-3.0 whole header"), (agpl, "AGPL-3.0 whole header")]
    cases += [(f"/*\n{x}\n*/\n\nint main() {{ return 0; }}\n", n) for x, n in ((mit, "MIT permission"), (mpl, "MPL-2.0 header"), (lgpl, "LGPL-2.1 header"), (isc, "ISC permission"))]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    for i, (_, name) in enumerate(cases):
        assert name in got[i]["licences"].split(","), (name, got[i])
        if not name.endswith(" text"):
            assert got[i]["best_licence"].split()[0] == name.split()[0] and got[i]["best_dice"] > 0.95, (name, got[i])
