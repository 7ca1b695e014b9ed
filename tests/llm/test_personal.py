import pytest

from threadloom.llm import personal as p

NAMES = ["Anna", "Boris"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        "Dear Anna Meyer, call +44 7700 900006 please.", "Dear Boris Falk, text +44 7700 900117 now.", "Dear Anna Falk, hello.", "Dear Unlisted Falk, hello.",
        "My number is +1 212 555 0100.", "My number is +1 212 555 0101.", "My number is 212 555 0199.", "Version 1.2.3 took 443.150.291 ns.",
        "SSN 912-34-5678 and SSN 913-34-5678.", "He pasted 914-34-5678 there.", "Mail anna+x@mail.example.test or boris (at) post [dot] example.", "Pin schema@5.6.9 and a @ b.",
        "I live at Flat 3, 12b Copper Street, Torvale.", "Adresse: Lindenstr. 30b in Bad Ort", "J’habite 56 bis, rue de l'Aulne à Ville.", "Calle del Pozo Seco, n.º 12 en Villa",
        "", None, "   ", "MEYER, Anna wrote it. Monday Standup moved to room 35.", "hi, my name is anna meyer and it fails",
    ]
    rows = [(i, t, "kind") for i, t in enumerate(texts)]
    rows += [(100 + i, f"My number is +1 212 555 01{i:02d}.", "kind") for i in range(10, 20)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


def test_found_and_redacted(spark, docs):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    spans = p.find(docs, names)
    got = {}
    for r in p.found_rows(spans).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.pii_key))
    assert {("name", "annameyer"), ("phone", "447700900006")} <= got[0]
    assert ("name", "unlistedfalk") in got[3]
    assert got[6] == {("phone", "2125550199")} and 7 not in got and 11 not in got
    assert got[8] == {("id_number", "912345678"), ("id_number", "913345678")} and got[9] == {("id_number", "914345678")}
    assert got[10] == {("email", "annaxmailexampletest"), ("email", "borisatpostdotexample")}
    assert [got[i] for i in (12, 13, 14, 15)] == [{("address", k)} for k in ("12bcopperstreet", "lindenstr30b", "56bisruedelaulne", "calledelpozoseconº12")]
    assert got[19] == {("name", "meyeranna")} and got[20] == {("name", "annameyer")}
    text = {r.doc_id: r.text for r in p.redact(docs, spans).collect()}
    assert text[0] == "Dear [NAME], call [PHONE] please." and text[16] == "" and text[17] is None and text[18] == "   "
    assert text[12] == "I live at Flat 3, [ADDRESS], Torvale." and text[11] == "Pin schema@5.6.9 and a @ b."
    assert len(text) == docs.count()


def test_empty_table(spark, docs):
    names = spark.createDataFrame([], "name string")
    assert p.found_rows(p.find(docs.limit(0), names)).count() == 0


def test_parts():
    assert p.signature("+1 (212) 555‑0100") == "+9 (999) 999-9999"
    assert p.pii_key("12b, Rue-É 4") == "12brueé4"
    best = p._resolved([{"start": 0, "stop": 5, "kind": "name", "belief": 0.9, "by_mate": 0.1}, {"start": 3, "stop": 9, "kind": "name", "belief": 0.9, "by_mate": 0.5}])
    assert [s["start"] for s in best] == [3]


def test_unlisted_lower_case_names_in_learned_contexts(spark):
    pairs = [(g, f) for g in ("anna", "boris") for f in ("meyer", "falk", "zorn", "adler", "brandt", "winter", "keller", "vogt")]
    texts = ["this is selshumir ulvaro from support, hello", "this is nothing special from support, hello"]
    texts += [f"this is {g} {f} from support, hello" for g, f in pairs] + [f"Dear {g.title()} {f.title()}, hi" for g, f in pairs] * 4
    texts += ["there was nothing special there and nothing special here"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    spans = p.find(docs, names)
    found = {(r.kind, r.pii_key) for r in p.found_rows(spans).collect()}
    assert ("name", "selshumirulvaro") in found and ("name", "nothingspecial") not in found
    text = {r.doc_id: r.text for r in p.redact(docs, spans).collect()}
    assert text[0] == "this is [NAME] from support, hello" and text[1] == texts[1]
