import math
import random
from collections import Counter

from weft.llm import spam

DDL = "doc_id bigint, lang string, text string, n int, share double"
NOUNS = "river garden market table window station letter bridge engine museum kettle ladder painter harbour basket camera".split()
VERBS = "opened carried repaired described measured ignored cleaned moved".split()


def prose(rng, n):
    return " ".join(f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} was {rng.choice(VERBS)} by a {rng.choice(NOUNS)} and it is in the {rng.choice(NOUNS)}." for _ in range(n))


def stuffed(rng, n):
    keys = rng.sample(NOUNS, 4)
    return " ".join(" ".join(rng.choice(keys) for _ in range(6)).capitalize() + rng.choice(".!?") for _ in range(n))


def links(rng, n):
    return "\n".join(f"{rng.choice(NOUNS)} {rng.choice(NOUNS)} https://{rng.choice(NOUNS)}.example/{rng.choice(NOUNS)}" for _ in range(n))


def tags(rng, n):
    return " ".join(f"#{rng.choice(NOUNS)}{rng.choice(NOUNS)}" for _ in range(3 * n))


def corpus():
    rng = random.Random(5)
    menu = "Home\nContact\nSearch\n"
    rows, bad = [], set()
    for i in range(400):
        rows.append((i, rng.choice(["en", "EN", None, "xx"]), menu + prose(rng, rng.randrange(3, 30))))
    for i in range(400, 460):
        rows.append((i, "en", menu + rng.choice([stuffed, links, tags])(rng, rng.randrange(10, 40))))
        bad.add(i)
    for i in range(460, 480):
        rows.append((i, "en", menu + prose(rng, 20) + "\n" + stuffed(rng, 8)))
    for i in range(480, 500):
        rows.append((i, "en", menu + prose(rng, 3) + "\n" + stuffed(rng, 30)))
        bad.add(i)
    return rows + [(500, "en", None), (501, "en", ""), (502, None, "404"), (None, "en", "x y z"), (400, "en", rows[400][2])], bad


def test_recall_and_precision_on_made_pages(spark):
    rows, bad = corpus()
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], DDL)
    found = [r["doc_id"] for r in spam.find_spam(df).collect()]
    assert len(found) == len(set(found))
    assert len(set(found) & bad) >= 0.95 * len(bad) and len(set(found) - bad) <= 2


def test_copies_of_a_list_are_no_menu(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    listed = "\n".join(" ".join(rng.sample(words, 2)) for _ in range(30))
    rows = [(i, "en", "Home\nContact\n" + prose(rng, rng.randrange(3, 30))) for i in range(200)]
    copies = [(i, "en", f"Home\nContact\n{listed}\nMirror of this page.\nLast change: {i}, by {rng.choice(words)}") for i in range(200, 300)]
    other = [(300, "en", " ".join(rng.choice(words) for _ in range(80)))]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows + copies + other], DDL)
    assert set(spam.recurring_lines(df)) == {"Home", "Contact"}
    assert {r["doc_id"] for r in spam.find_spam(df).collect()} == set(range(200, 301))


def test_a_line_is_left_out_as_a_run_of_whole_entries_only():
    reader = spam.Reader(["Home", "About us", "Last change: 2023"])
    left = lambda text: [low for low, _ in reader.lines(text)[0]]
    assert left("Home | About us\nOnes own words.") == ["ones own words."]
    assert left("Us home.\nAbout home.\nHome home.") == ["us home.", "about home.", "home home."]
    assert len(left("\n".join(f"Home {c}bout us." for c in "aAaA"))) == 3


def test_prose_words_are_counted_over_all_seed_pages(spark):
    rows = [(i, "the" + " w" * (i % 7 + i // 1000)) for i in range(2500)]
    measured = spark.createDataFrame([(i, "en", True, False, False) for i, _ in rows], "doc_id bigint, lang string, reference boolean, lacking boolean, extreme boolean")
    words, usual = spam.prose_words(spark.createDataFrame(rows, "doc_id bigint, own string"), measured)
    assert words == {"en": frozenset(spam.FUNCTION_WORDS["en"].split())} and abs(usual["en"] - 2500 / sum(len(t.split()) for _, t in rows)) < 1e-12


def test_words_are_learnt_from_what_lists_lack_on_many_pages(spark):
    prose_pages = [(i, "the opened river garden market", True) for i in range(200)]
    lists = [(200 + i, " ".join([("river", "garden", "market")[i % 3]] * 9), False) for i in range(12)]
    read = spark.createDataFrame([r[:2] for r in prose_pages + lists], "doc_id bigint, own string")
    measured = spark.createDataFrame([(k, "en", good, not good, not good) for k, _, good in prose_pages + lists], "doc_id bigint, lang string, reference boolean, lacking boolean, extreme boolean")
    words, _ = spam.prose_words(read, measured)
    assert "opened" in words["en"] and not words["en"] & {"river", "garden", "market"}
    assert "opened" not in spam.prose_words(read, measured.filter("doc_id < 205"))[0]["en"]


SAID = {
    "en": "The {0} of the {1} was carried by a {2} and it is in the {1}.",
    "es": "El {0} de la {1} era para un {2}, pero no es de los {1} que se ven en la {0}.",
    "de": "Der {0} und die {1} sind nicht auf dem {2}, weil es im {0} ist.",
    "fr": "Le {0} et la {1} ne sont pas dans un {2} qui est sur le {0}.",
}


def tag_list(rng, n, between):
    code = lambda: f"{rng.choice(['No', 'Art', 'REF', 'SKU'])}{rng.choice('#:- ')}{rng.randrange(10**5)}"
    return between.join(f"{rng.choice(NOUNS).capitalize()} {rng.choice(NOUNS)} {rng.choice(['M', 'XL', 'S-33'])} {code()}" for _ in range(n))


def test_product_codes_are_no_words_of_spanish(spark):
    rng = random.Random(11)
    rows = []
    for g, form in SAID.items():
        for i in range(120):
            rows.append((len(rows), rng.choice([g, None]), " ".join(form.format(*rng.sample(NOUNS, 3)) for _ in range(rng.randrange(4, 30)))))
    first = len(rows)
    for i in range(80):
        rows.append((len(rows), rng.choice(["en", "de", "es", "fr", None, "xx"]), tag_list(rng, rng.randrange(12, 60), rng.choice([" · ", "\n", ". ", ", "]))))
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], DDL)
    found = {r["doc_id"] for r in spam.find_spam(df).collect()}
    assert len([k for k in found if k >= first]) >= 76 and not [k for k in found if k < first]


def test_slope_and_residual_flag_as_well_as_divergence(spark):
    rng = random.Random(3)
    rows = [(i, "en", prose(rng, rng.randrange(3, 30))) for i in range(300)] + [(300, "en", stuffed(rng, 40)), (301, "en", "\n".join(["It is the river of a market in the garden."] * 60))]
    j = {r["doc_id"]: r for r in spam.judge(spark.createDataFrame([(*r, 0, 0.0) for r in rows], DDL)).collect()}
    assert j[300]["flagged"] and j[300]["divergence_z"] > 3 and j[300]["outside"] > 0.9
    # repeated sentences have an extreme curve, and are sentences all the same
    assert j[301]["extreme"] and abs(j[301]["residual_z"]) + abs(j[301]["slope_z"]) > 3 and j[301]["outside"] < 0.5
    assert sum(r["flagged"] for k, r in j.items() if k < 300) < 60


def test_prose_in_two_languages_and_in_an_unknown_one(spark):
    rng = random.Random(4)
    rows = [(i, "en", prose(rng, rng.randrange(3, 30))) for i in range(200)]
    rows += [(200 + i, "de", " ".join(SAID["de"].format(*rng.sample(NOUNS, 3)) for _ in range(rng.randrange(4, 30)))) for i in range(200)]
    both = (400, "de", " ".join(SAID["de"].format(*rng.sample(NOUNS, 3)) for _ in range(10)) + "\n" + prose(rng, 10))
    said = [f"{a} seisis vanal {b} juures ning vaatas kaua aega {c} poole" for a, b, c in (rng.sample(NOUNS, 3) for _ in range(12))]
    other = (401, "et", ". ".join(said) + ".")
    df = spark.createDataFrame([(*r, 0, 0.0) for r in [*rows, both, other]], DDL)
    j = {r["doc_id"]: r for r in spam.judge(df).collect()}
    assert j[400]["outside"] == 0 and j[401]["outside"] > 0.5 and (not j[401]["flagged"] or j[401]["extreme"])


def test_curves_are_least_squares(spark):
    counts = Counter("a a a a b b c c d e f".split())
    n = sum(counts.values())
    spectrum = sorted(Counter(counts.values()).items(), reverse=True)
    df = spark.createDataFrame([(1, "en", 0.1, n, [f for f, _ in spectrum], [m for _, m in spectrum])], "doc_id bigint, lang string, share double, n int, freq array<int>, words array<int>")
    rank, points = 0, []
    for f, m in spectrum:
        rank += m
        points.append((math.log(rank), math.log(f / n)))
    mx, my = (sum(c) / len(points) for c in zip(*points))
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    rest = math.sqrt(sum((y - my - slope * (x - mx)) ** 2 for x, y in points) / len(points))
    row = spam.curves(df).first()
    assert abs(row["slope"] - slope) < 1e-9 and abs(row["residual"] - rest) < 1e-9 and abs(row["head"] - 4 / n) < 1e-9


def test_text_read_in_a_wrong_encoding_is_put_right():
    right = "Говорят, что дом и сад в городе. Если лес рядом, то мост на реке."
    reader = spam.Reader([])
    for wrong, true in (("latin-1", "cp1251"), ("latin-1", "utf-8"), ("latin-1", "koi8-r"), ("cp1251", "utf-8")):
        page = reader.page(right.encode(true).decode(wrong, "replace"))
        assert page.languages == ["ru"] and page.share > 0.1 and "говорят" in page.counts
    page = reader.page("Le café et la forêt sont à côté de la bibliothèque. Le théâtre gêne la fête.".encode().decode("cp1251"))
    assert page.languages[0] == "fr" and "forêt" in page.counts


def test_lost_characters_do_not_break_words():
    assert spam.Reader([]).page("La for\ufffd\ufffdt et le th\ufffd\ufffd\ufffd\ufffdtre sont dans la ville.").n == 9


def test_empty(spark):
    assert spam.find_spam(spark.createDataFrame([], DDL)).count() == 0
    assert spam.find_spam(spark.createDataFrame([(1, None, None, 0, 0.0)], DDL)).count() == 0
