"""Truth tables and guard cases of single operators."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.functions import ids, money, priority, text, times
from newsloom.operators import baseline, corpus, entries, events, ledger, overlap, validators, views
from newsloom.operators.events import Overlay
from newsloom.operators.rules import RuleSet, Tag, rule_match
from newsloom.sources import feeds, files, pages


def one(df):
    return df.first()


def strings(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


RULES = RuleSet(
    gps={"acme": Tag(("Acme",)), "pq": Tag(("PQR",), needs_context=True)},
    sectors={"soft": Tag(("software",), needs_context=True)},
    context=("credit", "loan"),
    event=("raises", "default"),
    exclude=("podcast", "award"),
)


@pytest.mark.parametrize("sql_table", [False, True])
def test_rule_truth_table(spark, sql_table):
    rules = RuleSet.from_table(RULES.to_table(spark)) if sql_table else RULES
    cases = [
        ("Acme raises a fund", True, ["acme"], [], "matched"),
        ("acme RAISES a fund", True, ["acme"], [], "matched"),
        ("PQR raises credit fund", True, ["pq"], [], "matched"),
        ("pqr raises credit fund", False, [], [], "no tracked manager or sub-sector"),
        ("PQR raises equity", False, [], [], "no tracked manager or sub-sector"),
        ("SPQR raises credit", False, [], [], "no tracked manager or sub-sector"),
        ("éPQR raises credit", False, [], [], "no tracked manager or sub-sector"),
        ("Acme software loan outlook", False, ["acme"], ["soft"], "no material event"),
        ("Acme raises on a Podcast award", False, ["acme"], [], "excluded: podcast"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "text string")
    got = {r["text"]: r for r in rule_match(df, rules).collect()}
    for t, keep, gps, sectors, reason in cases:
        assert (got[t]["keep"], got[t]["gps"], got[t]["sectors"], got[t]["reason"]) == (keep, gps, sectors, reason)


def test_titles_ids_and_hosts(spark):
    df = strings(spark, ["Ｆoo “Bar” – BAZ  Straße - Daily News"])
    assert one(df.select(text.title_key(F.col("x"))))[0] == 'foo "bar" - baz strasse'
    u = strings(spark, ["HTTPS://A.example/p?utm_source=q&b=1&fbclid=2#frag"])
    r = one(u.select(ids.event_url(F.col("x")), ids.evidence_url(F.col("x")), ids.uuid5_url(F.lit("https://a.example/")), ids.card_id(F.lit(" https://A.example/x/#y "))))
    import hashlib
    import uuid

    assert r[0] == "https://a.example/p?b=1"
    assert r[1] == "HTTPS://A.example/p?b=1#frag".replace("HTTPS", "https")
    assert r[2] == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a.example/"))
    assert r[3] == hashlib.sha256(b"https://a.example/x").hexdigest()[:12]
    h = strings(spark, ["https://a.reg.example/x", "https://notreg.example/x", "https://reg.example/"])
    assert [x[0] for x in h.select(ids.host_in(F.col("x"), ["reg.example"])).collect()] == [True, False, True]
    row = spark.createDataFrame([("b", None, 1)], "z string, gone string, a int").select(ids.canonical_hash(F.struct("z", "gone", "a")).alias("h"))
    assert one(row)["h"] == hashlib.sha256(json.dumps({"a": 1, "z": "b"}, sort_keys=True).encode()).hexdigest()


def test_absence_claims_and_amounts(spark):
    df = strings(spark, ['Fund titled "Soft." No further details were given. It closed.', "No further details were given."])
    assert [r[0] for r in df.select(text.strip_absence(F.col("x"))).collect()] == ['Fund titled "Soft." It closed.', "No further details were given."]
    zh = strings(spark, ["公司募资。未披露更多细节。"])
    assert one(zh.select(text.strip_absence(F.col("x"), "zh")))[0] == "公司募资。"
    m = strings(spark, ["$7.3 billion, EUR 50.75 million and GBP 12 million; $5m"])
    got = [(c["currency"], c["amount"], c["unit"]) for c in one(m.select(money.amounts(F.col("x"))))[0]]
    assert got == [("USD", 7.3, "billion"), ("EUR", 50.75, "million"), ("GBP", 12.0, "million"), ("USD", 5.0, "plain")]
    f = strings(spark, ["7.3 billion", "73亿", "5 banks"])
    facts = [[tuple(x) for x in r[0]] for r in f.select(money.numeric_facts(F.col("x"))).collect()]
    assert facts[0] == facts[1] == [("amount", 7.3e9)] and facts[2] == [("amount", 5e9)]


TEXT = "OTF suspended withdrawals after a material liquidity failure. The decision deadline is 2026-09-24T08:00:00+00:00."


def _assess(spark, raw, title="OTF suspends withdrawals", body=TEXT, primary=False):
    df = spark.createDataFrame([(json.dumps(raw) if raw is not None else None, title, body, primary)], "r string, t string, b string, p boolean")
    return df.select(priority.validate_assessment("r", "t", "b", "p").alias("a"))


def _raw(**changes):
    base = {
        "severity": "critical", "linkage": "direct", "current_adverse": True, "resolved": False, "deadline_at": "2026-09-24T08:00:00+00:00", "reason_en": "Suspended.", "reason_zh": "暂停赎回。",
        "quotes": {
            "severity": "material liquidity failure", "linkage": ["OTF  suspended withdrawals"], "current_adverse": "OTF suspended withdrawals", "deadline_at": "deadline is 2026-09-24T08:00:00+00:00",
        },
    }
    return {**base, **changes}


def _class(df, as_of):
    return one(df.select(priority.classify(F.col("a"), F.to_timestamp(F.lit(as_of))).alias("p")))["p"]


def test_assessment_needs_verbatim_quotes_and_expires(spark):
    a = _assess(spark, _raw())
    got = one(a)["a"]
    assert got["assessable"] and got["evidence_refs"]["linkage"]["start"] == 0 and got["evidence_strength"] == "reported"
    p = _class(a, "2026-09-23T08:00:00+00:00")
    assert (p["priority"], p["time_sensitivity"]) == ("urgent", "48h")
    assert _class(a, "2026-09-26T08:00:00+00:00")["time_sensitivity"] == "monitor"
    for raw, body in [(None, TEXT), ([], TEXT), (_raw(severity="huge"), TEXT), (_raw(quotes={"severity": "invented words"}), TEXT), (_raw(), "OTF suspends withdrawals"), (_raw(resolved=True), TEXT)]:
        bad = _assess(spark, raw, body=body)
        assert not one(bad)["a"]["assessable"]
        assert _class(bad, "2026-09-23T08:00:00+00:00")["priority"] == "needs_review"
    calm = _assess(spark, _raw(severity="substantial", current_adverse=False, deadline_at=None, routine=True), primary=True)
    p = _class(calm, "2026-09-23T08:00:00+00:00")
    assert (p["priority"], p["routine"], p["evidence_strength"]) == ("important", True, "primary")
    vague = _assess(spark, _raw(reason_en="No terms were disclosed."))
    assert _class(vague, "2026-09-23T08:00:00+00:00")["reason"]["en"] == "Assessed severity: critical; linkage: direct."


def test_assessment_members_have_their_json_type(spark):
    """All cases in one frame: (raw, title, body, primary) to (assessable, failure, places of quotes)."""
    quotes = _raw()["quotes"]
    bad = "Missing or insufficient source evidence"
    no = lambda name: f"unsupported_claim:{name}"
    cases = [
        (json.dumps(_raw()), True, None, 4), (json.dumps(_raw(quotes={**quotes, "linkage": ["OTF suspended withdrawals", None]})), False, no("linkage"), 1),
        (json.dumps(_raw(quotes={**quotes, "severity": ["short"]})), False, no("severity"), 0), (json.dumps(_raw(quotes={**quotes, "severity": 7})), False, no("severity"), 0),
        (json.dumps(_raw(quotes={**quotes, "deadline_at": "The decision deadline"})), False, bad, 3), (json.dumps(_raw(quotes=["x"])), False, bad, 0), (json.dumps(_raw(current_adverse="true")), False, bad, 0),
        (json.dumps(_raw(current_adverse=1)), False, bad, 0), (json.dumps(_raw(deadline_at="2026-09-24")), False, bad, 0), (json.dumps(_raw(deadline_at=5)), False, bad, 0), (json.dumps(_raw(deadline_at="")), False, bad, 0),
        (json.dumps(_raw(severity=["critical"])), False, bad, 0), (json.dumps(_raw(linkage="unknown")), False, bad, 0), (json.dumps(_raw(reason_zh="no han")), False, bad, 4), (json.dumps(_raw(reason_en="  ")), False, bad, 4),
        (json.dumps(_raw(reason_en=None)), False, bad, 4), ("{broken", False, bad, 0), ("[1]", False, bad, 0), ("null", False, bad, 0), ('"text"', False, bad, 0), (None, False, bad, 0), ("", False, bad, 0),
        (json.dumps(_raw(deadline_at=None, resolved=True, quotes={**quotes, "resolved": "material  liquidity"})), True, None, 4), (json.dumps({**_raw(), "more": {"a": [1]}}), True, None, 4),
    ]
    rows = [(i, c[0], "t", f"\u2003{TEXT} ", None) for i, c in enumerate(cases)] + [(100, cases[0][0], f" {TEXT}", TEXT, True), (101, cases[0][0], None, None, True), (102, cases[0][0], "Payment  default", "x \U0001f600 material impairment", True)]
    df = spark.createDataFrame(rows, "i int, r string, t string, b string, p boolean")
    got = {r["i"]: r["a"] for r in df.select("i", priority.validate_assessment("r", "t", "b", "p").alias("a")).collect()}
    for i, (_, good, failure, places) in enumerate(cases):
        assert (got[i]["assessable"], got[i]["failure"], len(got[i]["evidence_refs"])) == (good, failure, places), i
        assert good or (got[i]["severity"], got[i]["reason"], got[i]["routine"]) == (None, None, None)
    assert [got[i]["assessable"] for i in (100, 101, 102)] == [False] * 3 and got[102]["potential_urgent"] and not got[101]["potential_urgent"]
    assert got[0]["evidence_refs"]["severity"]["start"] == TEXT.index("material liquidity") and got[0]["source_sha256"] == hashlib.sha256(TEXT.encode()).hexdigest()


def test_pages_and_filings(spark):
    html = (
        "<html><head><title>T &amp; U</title><meta property='og:title' content='Real  title'><meta name='description' content='Lead text.'>"
        "<meta name='date' content=' 2024-01-02 '></head><body><nav><p>menu entry that is long enough to count as text</p></nav>"
        + "".join(f"<p>Paragraph number {i} has certainly more than thirty characters.</p>" for i in range(8))
        + "<p>short</p></body></html>"
    )
    r = one(pages.extract_pages(spark.createDataFrame([(html,)], "html string")))
    assert r["title"] == "Real title" and r["source_published_at"] == "2024-01-02" and r["level"] == "excerpt"
    assert r["excerpt"].startswith("Lead text. Paragraph number 0") and "menu" not in r["excerpt"] and "short" not in r["excerpt"]
    div = "<div>Intro Section 13(a) of the Exchange Act. ☐ " + "body words " * 60 + "</div><script>\"datePublished\": \"2024-05-06T00:00\"</script>"
    r = one(pages.extract_pages(spark.createDataFrame([(div,)], "html string")))
    assert r["excerpt"].startswith("body words") and r["source_published_at"] == "2024-05-06T00:00"


def test_feeds(spark):
    rss = """<rss version="2.0"><channel><title>Feed</title>
      <item><title>Big deal - Daily</title><link>https://x.example/1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate><source url="u">Daily</source><description>Big deal - Daily</description></item>
      <item><title>Other &amp;amp; more</title><link>https://x.example/2</link><pubDate>02 Jan 2024 10:00:00 GMT</pubDate><description>&lt;b&gt;Body&lt;/b&gt; text</description></item>
      <item><title>No date</title><link>https://x.example/3</link><pubDate>soon</pubDate></item></channel></rss>"""
    got = feeds.parse_rss(spark.createDataFrame([("f", rss)], "feed string, payload string")).orderBy("url").collect()
    assert [(r["title"], r["publisher"], r["description"]) for r in got] == [("Big deal", "Daily", ""), ("Other & more", "Feed", "Body text")]
    assert got[0]["published"] == dt.datetime(2024, 1, 1, 8)


def test_freshness_bounds_are_inclusive(spark):
    now = dt.datetime(2024, 1, 10, 12)
    at = [now - dt.timedelta(days=3), now - dt.timedelta(days=3, seconds=1), now + dt.timedelta(hours=1), now + dt.timedelta(hours=1, seconds=1)]
    df = spark.createDataFrame([(t,) for t in at], "published timestamp")
    kept = [r[0] for r in entries.fresh_entries(df, F.lit(now)).collect()]
    assert kept == [at[0], at[2]]


def _cards(spark, specs):
    base = {
        "date": dt.date(2024, 1, 1), "published_at": None, "headline": ("H", "标"), "summary": ("A summary.", "摘要"), "gps": ["g"], "sectors": [], "region": "US", "source": ("P", "https://x.example/1"),
        "review_status": "unreviewed", "origin": "auto_fetch", "source_headline": None, "source_fingerprint": None, "assessment": None, "relevance_reason": None, "event_identity": None, "evidence": None,
        "source_origin": None, "published_basis": None, "source_published_at": None, "observed_at": None, "supersedes_card_id": None, "material_update_confirmed": None,
    }
    data = [tuple({**base, **s}[f] for f in schemas.CARD.fieldNames()) for s in specs]
    return spark.createDataFrame(data, schemas.CARD).withColumn("card_sha256", F.lit("h"))


SPECS = [
    {"id": "a", "published_at": "2024-01-01T01:00:00+00:00", "source_headline": "Fund closes at $5bn", "summary": ("Short.", "摘")},
    {"id": "b", "date": dt.date(2024, 1, 3), "published_at": "2024-01-03T01:00:00+00:00", "source_headline": "FUND closes at  $5bn", "summary": ("A much longer summary.", "摘")},
    {"id": "c", "date": dt.date(2024, 1, 20), "published_at": "2024-01-20T01:00:00+00:00", "source_headline": "Fund closes at $5bn"},
    {"id": "d", "published_at": "2024-01-01T02:00:00+00:00", "source_fingerprint": "f", "source": ("P", "https://x.example/2?utm_a=1")},
    {"id": "e", "published_at": "2024-01-02T02:00:00+00:00", "date": dt.date(2024, 1, 2), "source_fingerprint": "f", "source": ("P", "https://x.example/2")},
    {"id": "f", "event_identity": ("s", "a", "o", "p", ["1"], "identity-v1")},
    {"id": "g", "event_identity": ("s", "a", "o", "p", ["1"], "identity-v1"), "published_at": "2024-01-05T00:00:00+00:00", "date": dt.date(2024, 1, 5)},
    {"id": "h"},
    {"id": "i", "source": ("P", "https://x.example/1"), "event_identity": ("s", "a", "o", "p", ["2"], "identity-v1"), "supersedes_card_id": "f", "observed_at": "2024-01-06T00:00:00+00:00", "material_update_confirmed": True},
]


def _groups(placed):
    out = {}
    for r in placed.select("event_id", "id", "merge_rule").collect():
        out.setdefault(r["event_id"], [set(), r["merge_rule"]])[0].add(r["id"])
    return {k: (frozenset(v[0]), v[1]) for k, v in out.items()}


def test_event_projection_and_replay(spark):
    cards = _cards(spark, SPECS)
    placed = events.place_cards(cards)
    got = _groups(placed)
    assert got == {
        "evt-a": (frozenset("ab"), "headline"), "evt-c": (frozenset("c"), "single"), "evt-d": (frozenset("de"), "source"),
        "evt-f": (frozenset("fgi"), "identity"), "evt-h": (frozenset("h"), "single"),
    }
    rows = {r["event_id"]: r for r in events.events(placed, F.to_timestamp(F.lit("2024-02-01T00:00:00+00:00"))).collect()}
    assert rows["evt-a"]["representative_card_id"] == "b" and rows["evt-a"]["last_material_update_at"] == "2024-01-01T01:00:00+00:00"
    assert rows["evt-f"]["representative_card_id"] == "i" and rows["evt-f"]["updated"]
    assert rows["evt-f"]["last_material_update_at"] == "2024-01-06T00:00:00+00:00"
    again = events.place_cards(_cards(spark, SPECS[::-1]), previous=placed.select("id", "event_id"))
    assert _groups(again) == got
    days = {(r["event_id"], str(r["date"])): r["further_coverage"] for r in events.event_days(placed).collect()}
    assert days[("evt-a", "2024-01-01")] is False and days[("evt-a", "2024-01-03")] is True


def test_overlay_binds_to_exact_cards(spark):
    cards = _cards(spark, SPECS)
    members = lambda sha: spark.createDataFrame(
        [("rev-1", "a", "H", sha, "coverage"), ("rev-1", "h", "H", "h", "update"), ("rev-1", "gone", "?", "h", "coverage")], "event_id string, id string, headline string, card_sha256 string, role string"
    )
    groups = spark.createDataFrame([("rev-1", "h", ["old-name"])], "event_id string, representative_card_id string, aliases array<string>")
    placed = events.place_cards(cards, Overlay(members=members("h"), groups=groups))
    assert _groups(placed)["rev-1"] == (frozenset("abh"), "reviewed")
    row = events.events(placed, F.current_timestamp()).filter("event_id = 'rev-1'").first()
    assert row["representative_card_id"] == "h"
    voided = events.place_cards(cards, Overlay(members=members("changed"), groups=groups))
    assert "rev-1" not in _groups(voided)
    twice = members("h").unionByName(members("h").filter("id = 'a'").withColumn("event_id", F.lit("rev-2")))
    with pytest.raises(Exception, match="two reviewed groups"):
        events.approved_members(cards.withColumn("headline_en", F.col("headline.en")), twice).collect()


def test_ancestors_survive_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None)], "entity string, parent string")
    got = {(r["entity"], r["ancestor"]) for r in baseline.ancestors(edges).collect()}
    assert {("a", "b"), ("a", "c"), ("b", "c"), ("b", "a"), ("c", "a"), ("c", "b")} <= got and all(e != "x" for e, _ in got)


def test_leaks_freeze_and_registers(spark):
    bad = T.StructType([T.StructField("meta", T.ArrayType(T.StructType([T.StructField("gold", T.StringType())])))])
    assert validators.leaking_fields(bad) == ["input.meta[].gold"]
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    frozen = corpus.freeze({"t": df})
    assert corpus.changed_since_freeze(frozen, corpus.freeze({"t": df})).count() == 0
    assert corpus.changed_since_freeze(frozen, corpus.freeze({"t": df.withColumn("b", F.lit("y"))})).count() == 1
    with pytest.raises(ValueError):
        corpus.register_cohort(df, "challenge", "v1")


def test_candidates_skip_private_links(spark):
    cards = spark.createDataFrame([("c", "alpha beta gamma delta")], "card_id string, headline string")
    links = ["https://ok.example/", "http://127.0.0.1/", "https://user:pw@x.example/", "https://news.google.com/", "ftp://x.example/", "https://a.wsj.com/", "http://8.8.8.8/"]
    results = spark.createDataFrame([("c", i, u, "alpha beta gamma delta") for i, u in enumerate(links)], "card_id string, pos int, url string, title string")
    assert [r["url"] for r in overlap.top_candidates(cards, results).orderBy("rank").collect()] == [links[0], links[6]]


def test_spend_faults_and_freshness(spark):
    led = spark.createDataFrame(
        [(1, "reserve", "a", 1.0, None), (2, "settle", "a", 0.5, False), (3, "reserve", "b", 2.0, None), (4, "reserve", "b", 2.0, None)],
        "seq long, kind string, request_id string, charged_usd double, usage_unknown boolean",
    ).withColumn("charged_usd", F.col("charged_usd").cast("decimal(18,6)"))
    r = one(ledger.spend_summary(ledger.spend_state(led), F.lit(10)))
    assert (float(r["charged_usd"]), float(r["remaining_usd"]), r["unsettled_requests"], r["faults"]) == (2.5, 7.5, 1, 1)


def test_day_files_sheets_and_tables(spark, tmp_path):
    folder = tmp_path / "days"
    folder.mkdir()
    card = {"id": "a" * 12, "date": "2024-01-02", "headline": {"en": "h", "zh": "标"}, "gps": ["g"], "sectors": []}
    (folder / "2024-01-02.json").write_text(json.dumps({"date": "2024-01-02", "items": [card]}, indent=1))
    (folder / "index.json").write_text("{}")
    got = files.read_cards(spark, str(folder)).collect()
    assert len(got) == 1 and got[0]["date"] == dt.date(2024, 1, 2) and got[0]["assessment"] is None
    sheet = tmp_path / "labels.csv"
    sheet.write_bytes(b"\xef\xbb\xbf" + "article_id,decision\r\n1,publish\r\n".encode())
    assert files.read_labels(spark, str(sheet)).columns == ["article_id", "decision"]
    table = str(tmp_path / "table")
    today = F.lit("2024-04-01").cast("date")
    df = lambda rows: spark.createDataFrame(rows, "id string, date string, published_at string").withColumn("date", F.col("date").cast("date"))
    files.write_days(spark, df([("1", "2024-03-01", "x"), ("2", "2024-03-02", "y"), ("3", "2023-12-01", "z")]), table, today)
    added = files.write_days(spark, df([("2", "2024-03-02", "y"), ("4", "2024-03-02", "w")]), table, today)
    assert [r["id"] for r in added.collect()] == ["4"]
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == ["1", "2", "4"]
    assert files.drop_expired_days(spark, table, "2024-06-30") == ["2024-03-01", "2024-03-02"]


def test_views_sort_and_filter(spark):
    df = spark.createDataFrame([("a", 2, 5, 0, ["g"]), ("b", None, 9, 1, ["g"]), ("c", 1, 1, 2, ["h"])], "id string, rank int, time int, ord int, gps array<string>")
    assert [r["id"] for r in views.sort_entries(df).collect()] == ["c", "a", "b"]
    assert [r["id"] for r in views.sort_entries(df, "newest").collect()] == ["b", "a", "c"]
    assert [r["id"] for r in views.tag_filter(df, gp="h").collect()] == ["c"]


def test_stamps(spark):
    df = strings(spark, ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00", "nonsense", None])
    got = [r[0] for r in df.select(times.stamp(F.col("x"), F.lit("2024-01-02").cast("date"))).collect()]
    assert got == ["2024-01-01T10:00:00Z"] + ["2024-01-02T00:00:00+08:00"] * 3


def test_placing_leaves_the_texts_behind(spark):
    """No step of placing writes or shuffles a summary; its length still chooses the card."""
    cards = _cards(spark, SPECS)
    placed = events.place_cards(cards)
    assert "summary" not in placed.columns
    sizes = {r["id"]: r["n"] for r in cards.select("id", F.length(events.strip_absence(F.col("summary.en"), "en")).alias("n")).collect()}
    assert {r["id"]: -r["rep_order"]["c"] for r in placed.collect()} == sizes
