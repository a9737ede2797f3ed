"""Rules on literal rows; expected values come from the rules, not from Spark."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vacantia.functions import answers, labels, markup, prompts, text
from vacantia.operators.filters import has_forbidden_term
from vacantia.sources.requests import apec_search_url

RELAXED = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def values(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in frame.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_salary_label(spark):
    rows = [
        (None, None, "fr"), (0.0, 60000.0, "fr"), (0.5, None, "fr"), (999.9, None, "gb"),
        (45000.0, 60000.0, "gb"), (45000.7, 1234567.9, "fr"), (-1500.5, None, "fr"), (45000.0, 0.0, "be"),
    ]
    expected = [
        "", "", "À partir de 0 €/an", "À partir de 999 £/an", "45 000 – 60 000 £/an",
        "45 000 – 1 234 567 €/an", "À partir de -1 500 €/an", "À partir de 45 000 €/an",
    ]
    column = labels.salary_label(F.col("a"), F.col("b"), F.col("c"))
    assert values(spark, rows, "a double, b double, c string", column) == expected


def test_contract_label(spark):
    rows = [
        ("full_time", None, "fr"), ("part_time", "", "fr"), ("full_time", "permanent", "fr"), ("part_time", "permanent", "gb"),
        (None, "contract", "fr"), (None, None, "fr"), ("autre", "autre", "fr"),
    ]
    column = labels.contract_label(F.col("a"), F.col("b"), F.col("c"))
    assert values(spark, rows, "a string, b string, c string", column) == [
        "Temps plein", "Temps partiel", "CDI", "Permanent", "CDD/Contrat", "", "",
    ]


@pytest.mark.parametrize(
    "function, bounds",
    [
        (labels.priority_dashboard, [(84, "★★ À CONSIDÉRER"), (85, "★★★ PRIORITAIRE"), (59, "★ FAIBLE"), (60, "★★ À CONSIDÉRER")]),
        (labels.priority_export, [(84, "★★☆ À CONSIDÉRER"), (85, "★★★ PRIORITAIRE"), (0, "★☆☆ FAIBLE")]),
        (labels.priority_report, [(79, "★★☆  À CONSIDÉRER"), (80, "★★★  PRIORITAIRE"), (59, "★☆☆  FAIBLE")]),
        (labels.fill_colour, [(85, "C6EFCE"), (60, "FFEB9C"), (59, "F2F2F2")]),
        (labels.text_colour, [(85, "color: #1a6b3a"), (60, "color: #7a4f00"), (59, "color: #666666")]),
        (labels.band, [(90, "90-100"), (89, "70-89"), (50, "50-69"), (30, "30-49"), (29, "0-29")]),
    ],
)
def test_score_classes(spark, function, bounds):
    assert values(spark, [(s,) for s, _ in bounds], "s int", function(F.col("s"))) == [label for _, label in bounds]


def test_sources_differ_in_case_only(spark):
    rows = [("https://www.Adzuna.fr/x",), ("https://apec.fr/adzuna",), ("x.INDEED.com",), (None,), ("",), ("indeed",)]
    assert values(spark, rows, "u string", labels.source_dashboard(F.col("u"))) == ["Adzuna", "Adzuna", "Indeed", "N/A", "N/A", "Indeed"]
    assert values(spark, rows, "u string", labels.source_export(F.col("u"))) == ["—", "Adzuna", "—", "—", "—", "Indeed"]


def test_contract_and_status_defaults(spark):
    rows = [(None,), ("",), ("  ",), (" CDI ",), ("CDD",)]
    assert values(spark, rows, "c string", labels.contract_filter_value(F.col("c"))) == ["N/A", "N/A", "N/A", "CDI", "CDD"]
    rows = [(None,), ("",), ("Postulé",), ("Archivé",)]
    assert values(spark, rows, "c string", labels.status_or_default(F.col("c"))) == ["À postuler", "", "Postulé", "Archivé"]
    assert values(spark, rows, "c string", labels.status_in_detail(F.col("c"))) == ["À postuler", "À postuler", "Postulé", "À postuler"]


SPACED = st.text(alphabet=st.sampled_from(list(" \t\n\r\x0b\x1c\x1f\x85\xa0 　ab`é​")), max_size=12)


@RELAXED
@given(st.lists(SPACED, min_size=1, max_size=40))
def test_strip_equals_python(spark, texts):
    assert values(spark, [(t,) for t in texts], "t string", text.strip(F.col("t"))) == [t.strip() for t in texts]


@RELAXED
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=20), min_size=1, max_size=40))
def test_percent_encode_equals_quote(spark, texts):
    assert values(spark, [(t,) for t in texts], "t string", text.percent_encode(F.col("t"))) == [quote(t) for t in texts]


def test_search_url_place(spark):
    rows = [("é +*~/", None), ("x", ""), ("x", "FRANCE"), ("x", "Lyon 2")]
    urls = values(spark, rows, "t string, p string", apec_search_url(F.col("t"), F.col("p")))
    assert "motsCles=%C3%A9%20%2B%2A~/&typesConvention=143684" in urls[0]
    assert [u.split("143687")[1] for u in urls] == ["", "", "", "&lieu=Lyon%202"]


FENCED = [
    ("```html\n<p>a</p>\n```", "<p>a</p>"),
    ("```\n<p>a</p>\n```", "<p>a</p>"),
    ("<p>a</p>", "<p>a</p>"),
    ("<p>```x```</p>", "<p>```x```</p>"),
    ("Voici\n```html\n<p>a</p>\n```", "Voici\n```html\n<p>a</p>"),
    ("```HTML\n<p>a</p>\n```", "HTML\n<p>a</p>"),
    ("```html\r\n<p>a</p>\r\n```\r\n", "<p>a</p>"),
    ("", ""),
    ("```", ""),
    ("``````", ""),
    ("````", "`"),
    ("```html```", ""),
    (" ```html x``` ", "x"),
]


def test_strip_fence_table(spark):
    got = values(spark, [(f,) for f, _ in FENCED], "t string", markup.strip_fence(F.col("t")))
    assert got == [want for _, want in FENCED]


def scanned(answer: str) -> str:
    """What lies between the fences, found by walking inwards from both ends one character at a time."""
    first, last = 0, len(answer)

    def skip_spaces(first, last):
        while first < last and answer[first].isspace():
            first += 1
        while last > first and answer[last - 1].isspace():
            last -= 1
        return first, last

    first, last = skip_spaces(first, last)
    ticks = 0
    while ticks < 3 and first + ticks < last and answer[first + ticks] == "`":
        ticks += 1
    if ticks == 3:
        first += 3
        if last - first >= 4 and list(answer[first : first + 4]) == ["h", "t", "m", "l"]:
            first += 4
    first, last = skip_spaces(first, last)
    ticks = 0
    while ticks < 3 and last - ticks > first and answer[last - 1 - ticks] == "`":
        ticks += 1
    if ticks == 3:
        last -= 3
    first, last = skip_spaces(first, last)
    return answer[first:last]


@RELAXED
@given(st.lists(st.lists(st.sampled_from(["`", "```", "html", "\n", " ", "x", "\xa0"]), max_size=8).map("".join), min_size=1, max_size=40))
def test_strip_fence_equals_scan(spark, texts):
    got = values(spark, [(t,) for t in texts], "t string", markup.strip_fence(F.col("t")))
    assert got == [scanned(t) for t in texts]


def test_forbidden_terms(spark):
    rows = [("Vente", "call"), ("COMMERCIAL é", ""), (None, None), ("Ingénieur", "Non Cadre"), ("a%b", "")]

    def marked(terms):
        return values(spark, rows, "t string, d string", has_forbidden_term(F.col("t"), F.col("d"), terms))

    assert marked([]) == [False] * 5
    assert marked([None]) == [False] * 5
    assert marked([""]) == [True] * 5
    assert marked(["e c"]) == [True, False, False, False, False]
    assert marked(["commercial É", None, "NON CADRE"]) == [False, True, False, True, False]
    assert marked(["%"]) == [False, False, False, False, True]
    many = [f"absent{i}" for i in range(300)] + ["CADRE"]
    assert marked(many) == [False, False, False, True, False]


WORDS = st.lists(st.sampled_from(["é", "É", "a", "B", "ß", " ", "%", "."]), max_size=6).map("".join)


@RELAXED
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=30), st.lists(WORDS, max_size=4))
def test_forbidden_terms_equal_python(spark, rows, terms):
    got = values(spark, rows, "t string, d string", has_forbidden_term(F.col("t"), F.col("d"), terms))
    assert got == [any(term.lower() in f"{t} {d}".lower() for term in terms) for t, d in rows]


def test_json_list_text_equals_python(spark):
    lists = [[], ["a"], ["a", "é, \"b\""], ["x\ny\t\\", "/", "", "🙂", "'"]]
    got = values(spark, [(v,) for v in lists], "v array<string>", text.json_list_text(F.col("v")))
    assert got == [json.dumps(v, ensure_ascii=False) for v in lists]


def test_line_count(spark):
    texts = ["", "a", "a\nb", "\n", "a\n\n"]
    assert values(spark, [(t,) for t in texts], "t string", text.line_count(F.col("t"))) == [len(t.split("\n")) for t in texts]


SCORES = [
    "85", '"85"', '" 85 "', '"85."', '"085"', '"+85"', '"8_5"', '"85.00"', '"85.10"', '"-0"', "1e2", '"1e2"', "85.0", "85.5",
    "true", "false", '"１２"', '"\\u00a085"', '"8__5"', '"_85"', '"85_"', '".0"', '"0.0"', '"85.0_0"', "100.0000001", "101", "-1",
    "null", '"true"', '""', '" "', '"8_5.0"', "[85]", "{}", '"0x10"', '"00000000000000000000000000000000000000000085"', "1e400", "12345678901234567890",
]
EXPLANATIONS = ['"ok"', '""', "3", "null", None]
LISTS = ["[]", '["a"]', "null", "[1]", '"a"', "[null]", '["a", null]', "{}", None]


def test_answers_equal_model(spark):
    pydantic = pytest.importorskip("pydantic")

    class Model(pydantic.BaseModel):
        score: int = pydantic.Field(ge=0, le=100)
        explication: str
        points_forts: list[str] = pydantic.Field(default_factory=list)
        points_faibles: list[str] = pydantic.Field(default_factory=list)

    cases = [(s, '"ok"', "[]", "[]") for s in SCORES] + [(None, '"ok"', "[]", "[]")]
    cases += [("7", e, "[]", "[]") for e in EXPLANATIONS]
    cases += [("7", '"ok"', a, b) for a in LISTS for b in LISTS]
    names = ("score", "explication", "points_forts", "points_faibles")
    texts = ["{" + ", ".join(f'"{n}": {v}' for n, v in zip(names, c) if v is not None) + "}" for c in cases]
    texts += ["pas du json", "[]", "3", "", '{"score": 5, "explication": "a", "autre": {"x": 1}}']

    def expected(answer):
        try:
            return tuple(Model.model_validate(json.loads(answer)).model_dump().values())
        except (ValueError, TypeError):
            return None

    got = values(spark, [(t,) for t in texts], "t string", answers.validated_answer(F.col("t")))
    assert [tuple(g) if g else None for g in got] == [expected(t) for t in texts]


def test_profile_defaults(spark):
    row = spark.range(1).select(prompts.profile_text(prompts.profile_literal({"candidat": {}})).alias("t")).first()
    lines = row.t.split("\n")
    assert lines[1:5] == ["Poste cible : Non précisé", "Expérience : ? ans", "Compétences techniques : ", "Soft skills : "]
    assert lines[8:12] == [
        "Salaire minimum : Non précisé €/an brut", "Télétravail souhaité : Non",
        "Localisation acceptée : Paris / Île-de-France", "Secteurs préférés : ",
    ]


def test_offer_text_cuts_description_at_code_points(spark):
    row = spark.createDataFrame(
        [("t", None, "", None, None, "é🙂" * 2000)],
        "intitule string, entreprise_nom string, lieu_travail string, type_contrat string, salaire_libelle string, description string",
    ).select(prompts.offer_text().alias("t")).first()
    assert row.t.split("\n")[2:4] == ["Entreprise : Non précisée", "Lieu : Non précisé"]
    assert row.t.split("\n")[-1] == "é🙂" * 1500


def brute_text(html: str) -> str:
    """Event by event, independent of the helper: split markup first, then read pieces."""
    events: list[str | None] = []
    hidden = [None]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            events.append(None)
            if tag in ("script", "style"):
                hidden[0] = tag

        def handle_endtag(self, tag):
            events.append(None)
            if tag == hidden[0]:
                hidden[0] = None

        def handle_data(self, data):
            if hidden[0] is None:
                events.append(data)

        def handle_comment(self, data):
            events.append(None)

        def handle_decl(self, decl):
            events.append(None)

    reader = Reader()
    reader.feed(html)
    reader.close()
    nodes, current = [], ""
    for event in [*events, None]:
        if event is None:
            nodes.append(current.strip())
            current = ""
        else:
            current += event
    return "\n".join(n for n in nodes if n)
