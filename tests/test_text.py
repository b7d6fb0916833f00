import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinweave.functions import recover as R
from kinweave.functions import similarity as S
from kinweave.functions import text as T


def test_normalize(column):
    assert column(T.normalize, ["Rebecca.Bellan", "U.S.", "Meta Platforms, Inc.", "AT&T", ""]) == ["rebecca bellan", "u s", "meta platforms inc", "at and t", ""]


def test_content_tokens_and_initials(column):
    assert column(lambda c: T.content_tokens(T.normalize(c)), ["Meta Platforms, Inc.", "AI Labs", "The Group"]) == [["meta", "platforms"], ["ai", "labs"], ["the", "group"]]
    assert column(lambda c: T.initials(T.content_tokens(T.normalize(c))), ["Securities and Exchange Commission"]) == ["sec"]


def test_fold(column):
    assert column(T.ascii_fold, ["Meléndez", "Straße", "北京", "Łódź"]) == ["Melendez", "Strasse", "", "Lodz"]


def test_acronyms(column):
    assert column(T.is_acronym, ["FTC", "U.S.", "H100", "Ftc", "A", "LONGNAME"]) == [True, True, False, False, False, False]


def test_clean_mention(column):
    assert column(T.clean_mention, ["and Replit", "the Federal Reserve", "OpenAI's", '"Anthropic",', "$LAPTOP"]) == ["Replit", "Federal Reserve", "OpenAI", "Anthropic", "$LAPTOP"]


@pytest.mark.parametrize(
    ("name", "kind", "good"),
    [("officials", "organization", False), ("AI labs", "organization", False), ("LA", "location", True), ("OpenAI", "organization", True), ("Procter and Gamble", "organization", True), ("META and Anthropic", "other", False), ("an AI model by Anthropic", "product", False), ("regulated workspace", "other", False), ("Association of Independent Regional Press Publishers of Ukraine", "organization", True), ("Mecka AI, another startup collecting data", "organization", False), ("", "other", False)],
)
def test_name_gate(column, name, kind, good):
    assert column(lambda c: T.plausible_name(c, F.lit(kind)), [name]) == [good]


def test_sentences_and_chunks(column):
    text = "One. Two! Three?\nFour"
    (sentences,) = column(T.split_sentences, [text])
    assert "".join(sentences) == text and len(sentences) == 4
    (chunks,) = column(lambda c: T.chunk_text(c, 10), [text])
    assert all(text[c["start"] :].startswith(c["chunk"]) and len(c["chunk"]) <= 10 for c in chunks) and "".join(c["chunk"] for c in chunks) == text


def test_html(column):
    line = "word " * 20
    assert column(T.html_to_text, [f"<html><script>x</script><nav>n</nav><p>{line}&amp;lt;</p><p>short</p><style>"]) == [line + "<"]
    assert column(T.strip_tags, ["<p>a <b>b</b></p> c"]) == ["a b c"]


def test_mentions(column):
    (found,) = column(T.mentions, ["Mistral AI raised funds in Paris. Mistral AI and Ed of é Zürich."])
    assert [(m["text"], m["start"]) for m in found] == [("Mistral AI", 0), ("Paris", 27)] or [m["text"] for m in found][:2] == ["Mistral AI", "Paris"]


def test_relations_and_questions(column):
    assert column(T.normalize_relation, ["Hosted Talks With", "--", "CEO-of"]) == ["hosted_talks_with", "related_to", "ceo_of"]
    assert column(T.relation_intents, ["Who acquired the rival?"])[0][:3] == ["acquired", "acquired_by", "merged_with"]
    assert column(T.relation_intents, ["hello"]) == [[]]
    assert column(T.citation_count, ["A sued B [2]. C acquired D [10][3].", "array[0] index [x] and [ 1 ]"]) == [3, 1]
    assert column(lambda c: T.contains_word(c, F.lit("meta")), ["about meta.", "metal", "pre-meta"]) == [True, False, True]


def test_uncited(column):
    sources = F.array(F.lit("https://example.org/a"))
    out = column(lambda c: T.flag_uncited(c, sources), ["no source", "see [1]", "at https://example.org/a"])
    assert [o.startswith("⚠") for o in out] == [True, False, False]


def test_jaro_winkler():
    for a, b, x in (("circle", "circle k", 0.95), ("microsoft", "microsoft research", 0.9), ("meta platforms inc", "meta", 0.8444), ("nvidia corporation", "nvidia", 0.8667), ("", "a", 0.0), ("a", "a", 1.0)):
        assert S.jaro_winkler(a, b) == pytest.approx(x, abs=1e-4)


def test_double_metaphone_agrees_with_the_published_implementation(spark):
    """Against the class that Spark's own class path holds, on the words of names."""
    coder = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    words = "meta platforms openai hegota google cloud microsoft research york city shasta ranger station goldman sachs asset management future reserve federal amodei dario altman kalanick zuckerberg ethereum foundation coinbase global amazon rebecca bellan zcash trust circle mercury delta washington thompson schmidt wright knight physics xavier czech church school bridge judge phone vision nation richard michael character chemistry".split()
    assert [(w, S.double_metaphone(w)) for w in words] == [(w, coder.doubleMetaphone(w)) for w in words]


def test_dates(column):
    raw = ["20260908T143000Z", "Mon, 08 Sep 2026 14:30:00 GMT", "2026-09-08T14:30:00Z", "2026-09-08", "not a date", "", None, "08 Sep 2026 14:30:00 +0200"]
    at = dt.datetime(2026, 9, 8, 14, 30)
    assert column(R.parse_feed_date, raw) == [at, at, at, dt.datetime(2026, 9, 8), None, None, None, dt.datetime(2026, 9, 8, 12, 30)]


def test_json_recovery(column):
    assert column(R.extract_json_object, ['x {"a": "}"} ;', "none", None]) == ['{"a": "}"}', None, None]
    got = R.decode('noise {"entities": [{"text": "Acme", "type": "Organization", "confidence": 3}, "Bob", ["X", "Y Z"]], "relations": [["Bob", "Acme", "ceo of"], ["a"]]}')
    assert [e["mention"] for e in got["entities"]] == ["Acme", "Bob", "X"] and got["entities"][0]["confidence"] == 1.0 and got["entities"][2]["canonical_name"] == "Y Z"
    assert got["relations"] == [{"a": "Bob", "b": "Acme", "relation": "ceo of"}]
    assert column(R.decode_extraction, ["{}"])[0].entities == []


def test_sidereal_time(column):
    out = column(R.gmst_radians, [dt.datetime(2000, 1, 1, 12)], "timestamp")
    assert out[0] == pytest.approx(4.894961, abs=1e-5)


def test_sentence_split_covers_every_document(spark):
    from kinweave import queries

    data = "/root/testdata/sf0.001"
    counts = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        raw, at, n = (r.text or "").encode(), 0, 0
        for i, byte in enumerate(raw):
            if byte in b".!?\n" and (i + 1 == len(raw) or raw[i + 1] in b" \t\n\v\f\r"):
                at, n = i + 1, n + 1
        counts[r.doc_id] = n + (at < len(raw))
    got = {r.doc_id: r.n for r in queries.sentence_split(spark, data).collect()}
    assert got == counts
    duckdb = pytest.importorskip("duckdb")
    sql = duckdb.sql(queries.ORACLES["sentence_split"].replace("FROM documents", f"FROM '{data}/documents.parquet'")).fetchall()
    assert dict(sql) == got  # the SQL covers every document too
