import pytest

from pointloom.llm import residue

KIND = "doc_id long, text string, cell_kinds array<string>, cell_starts array<int>, repo string, host string, line string"


@pytest.mark.parametrize(
    "line, kind",
    [
        ("# {{ title }}", "template"), ("**Author** : <<ADD AUTHOR>>", "template"), ("$SUMMARY$ We compare both.", "template"), ("The runs agree. [insert title here] Next we plot.", "template"), ("TODO: your name here", "template"),
        ("(votre contact ici…)", "template"), ("*hier Datum eintragen* ________", "template"), ("Título: [fecha por completar]", "template"), ("Date: __DATE__", "template"), ("#{name}", "template"),
        ("Sample text, sample text, SAMPLE TEXT", "filler"), ("Texte d'exemple.", "filler"), ("asdf qwer foo bar bla asdf", "filler"), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("Sa rita la pum fesitmofe.", "filler"),
        ("HTTP 503 – Service temporarily unavailable", "error"), ("Error 404", "error"), ("<html><head><title>Page not found</title></head><body></body></html>", "error"), ("Too many requests (429)", "error"), ("Accès refusé", "error"), ("418 I am a teapot", "error"),
        ("Please enable JavaScript to view this notebook.", "scripts"), ("<noscript>anything</noscript>", "scripts"), ("Diese Seite braucht Skripte. Bitte einschalten.", "scripts"),
        ("Double braces as in {{ author }} mark a variable of the template language;", None), ("Call `run.sh --date <date>`, where `<date>` is a name of your choice.", None), ("A row whose title reads [insert title here] is thrown out below;", None),
        ('We drop pages that say "Page not found" before training;', None), ("Our crawler met the answer 503 (service unavailable) twice;", None), ("The site builds its list with JavaScript, so we read the feed.", None), ("A browser would ask to enable JavaScript here, our reader does not;", None),
        ('Dummy text such as "sample text" is removed before counting words;', None), ("# %% [markdown]", None), ("$$ x_{k} = {a}_{0} $$", None), ("[a link](https://example.org/404)", None), ("After 404 passes the canopy is still shaded.", None), ("", None), ("- **Note** the slope", None),
    ],
)
def test_evidence(line, kind):
    assert residue.evidence(line) == kind


def docs(spark, rows):
    return spark.createDataFrame([(*r, "h", "l") for r in rows], KIND)


def test_only_text_cells_count(spark):
    rows = [
        (1, "good prose\n{{ title }}", ["text", "code"], [0, 11], "r"),
        (2, "good prose\n{{ title }}", ["code", "text"], [0, 11], "r"),
        (3, "é\r\n{{ title }}\r\nx", ["code", "text", "code"], [0, 3, 16], "r"),
        (4, "", [], [], "r"), (5, None, None, None, None), (6, "Error 404", None, None, None), (7, "Error 404 and " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9000)), ["text"], [0], "r"), (None, "Error 404", ["text"], [0], "r"),
    ]
    got = {r["doc_id"]: r["kinds"] for r in residue.residue(docs(spark, rows)).collect()}
    assert got == {2: ["template"], 3: ["template"], 6: ["error"]}
    assert sorted(r["doc_id"] for r in residue.without_residue(docs(spark, rows)).collect() if r["doc_id"]) == [1, 4, 5, 7]


#: Wordings of hosts, generators and languages that no test table holds.
FOREIGN = [
    ("Sorry, this page cannot be displayed.", "error"), ("Oops! That page can't be found", "error"), ("Page not found - GitHub", "error"), ("We're sorry, but an error has occurred", "error"), ("The resource you are looking for could not be found", "error"),
    ("404 | This document does not exist", "error"), ("Your file has been moved or removed.", "error"), ("502 Bad Gateway", "error"), ("You are not authorized to view this content.", "error"), ("Access restricted", "error"), ("This article is no longer available.", "error"),
    ("Cette ressource n'existe plus.", "error"), ("Document introuvable", "error"), ("Este recurso no está disponible", "error"), ("Esta página foi removida", "error"), ("Diese Seite existiert nicht mehr.", "error"), ("Der Server ist vorübergehend nicht erreichbar", "error"), ("Entschuldigung, die Datei wurde nicht gefunden", "error"),
    ("You must have JavaScript enabled to use this site", "scripts"), ("JavaScript must be enabled to view this application.", "scripts"), ("This site requires JavaScript to work.", "scripts"), ("The app will not work without JavaScript.", "scripts"), ("Vous devez activer JavaScript.", "scripts"), ("Este sitio requiere JavaScript.", "scripts"), ("JavaScript muss aktiviert sein", "scripts"),
    ("Placeholder text goes here.", "filler"), ("More text to follow soon", "filler"), ("Texte factice", "filler"), ("Mustertext hier", "filler"), ("Content goes here", "filler"),
    ("The page we scraped was not found by the second crawler, so its row is empty.", None), ("An error occurred in 3 of 40 runs, all with the old driver.", None), ("The server was too busy to answer all requests on Monday.", None), ("We enable JavaScript in the test browser before the run.", None),
    ("The site needs JavaScript for its list, so we read the feed instead.", None), ("Sample text is stored in the second column.", None), ("If the file does not exist, it is created.", None), ("## Access rights of the file server", None), ("The resource was not found by 2 of 3 readers.", None), ("Not all pages are available.", None),
]


@pytest.mark.parametrize("line, kind", FOREIGN)
def test_wordings_from_elsewhere(line, kind):
    assert residue.evidence(line) == kind


def test_a_frame_of_the_host_is_no_evidence(spark):
    frame = "Please enable JavaScript to view this notebook."
    rows = [(i, f"{frame}\nown words {chr(97 + i % 26)} {chr(97 + i // 26)}", ["text"], [0], "framed") for i in range(60)] + [(100, f"{frame}\nError 404", ["text"], [0], "framed"), (101, frame, ["text"], [0], "single"), (102, frame, ["text"], [0], "framed")]
    got = {r["doc_id"] for r in residue.residue(docs(spark, rows)).collect()}
    assert got == {100, 101, 102}  # 102 has nothing but the frame


def test_a_frame_is_judged_by_shares_at_every_size(spark):
    frame = "Please enable JavaScript to view this notebook."
    letters = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuv"]
    few = [(i, f"{frame}\nown {letters[i]}", ["text"], [0], "few") for i in range(3)]  # three documents speak for no share
    half = [(1000 + i, f"{frame if i % 2 else 'a quiet line'}\nown {letters[i]}", ["text"], [0], "half") for i in range(200)]  # half of them is not surely more than half
    most = [(2000 + i, f"{frame if i % 8 else 'a quiet line'}\nown {letters[i]}", ["text"], [0], "most") for i in range(200)]
    copies = [(3000 + i, f"{frame}\nthe same text", ["text"], [0], "copies") for i in range(40)]  # copies of one text count once
    got = {r["doc_id"] for r in residue.residue(docs(spark, few + half + most + copies)).collect()}
    assert got == {0, 1, 2} | {1000 + i for i in range(200) if i % 2} | {3000 + i for i in range(40)}


def test_empty(spark):
    assert residue.residue(docs(spark, [])).collect() == []
