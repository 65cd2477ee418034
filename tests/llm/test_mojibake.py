import random

import pytest

from spanloom.llm import mojibake as M

CLEAN = {
    "de": "Für mich das beste Stück: läuft täglich, schöne Größe, möchten noch öfter üben",
    "fr": "Reçu en avance, c’est même mieux que prévu – déjà très réussie, ma sœur a adoré",
    "es": "Después de unos días llegó el otoño, ningún daño en las páginas",
    "pt": "Não tenho nada a reclamar, ocasiões variadas e maçã à família",
    "pl": "Paczka przyszła wcześniej, jakość wyższa niż na zdjęciu, żółty dość ładny końca",
    "ru": "Очень довольна, работает отлично и выглядит лучше чем раньше",
}
UNUSUAL = [
    "Ingredients: Ã-type starch, Ð-malt.",
    "Symbols on the dial: ┤ ├ ║ ° ¶.",
    "The label says “Ñandú – São Ávila” ©.",
    "ÇA VÀ, TOUT À FAIT. ÉTÉ, ÂMBAR ÉTOILE",
    "It holds 3 m³ of air at ±2 °C, area 12 cm², model Ω-µ7, thickness 80 µm",
    "Price list: 5¢, 10¢, 20¢ ¬ tax; £40 (½ of the usual), №7 §4",
    "after «the» glacier; ¿El color? ¡Estoy encantada!",
    "ДОСТАВКА ЗАНЯЛА 2 ДНЯ, ОЧЕНЬ ДОВОЛЬНА",
    "日本語のテキスト und 中文字符, Ελληνικά κείμενα, עברית, العربية",
    "❤️ 👍🏽 ⭐⭐⭐ 🏕️",
    "naïve café, L’ARRIVÉE, Zażółć gęślą jaźń, ŻÓŁĆ",
    "",
    "plain text & more; 100% \\ fine",
]
# (true encoding, encoding that it was taken for, languages)
WRONG = [
    ("utf-8", "cp1252", "de fr es pt pl"), ("utf-8", "latin-1", "de fr es pt pl ru"), ("utf-8", "cp1251", "de fr es pt ru"), ("utf-8", "cp1250", "de pl"), ("utf-8", "mac_roman", "de fr es pt"),
    ("utf-8", "cp437", "de fr es pt"), ("latin-1", "cp850", "de es pt"), ("latin-1", "mac_roman", "de es pt"), ("mac_roman", "cp1252", "de es"), ("iso8859-2", "latin-1", "pl"),
    ("cp1250", "cp1252", "pl"), ("cp1251", "latin-1", "ru"), ("koi8-r", "cp1251", "ru"), ("cp437", "latin-1", "de es"),
]


def garble(text, right, wrong):
    def byte(b):
        try:
            return bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            return chr(b)

    return "".join(byte(b) for b in text.encode(right, "replace"))


def docs():
    """Clean documents in every language many times, as a corpus is mostly right, and one of each kind of damage."""
    out, bad, origin = [], set(), {}
    for k in range(40):
        for t in CLEAN.values():
            out.append((len(out), f"{t}. {k}"))
    for t in UNUSUAL:
        out.append((len(out), t))
    for right, wrong, langs in WRONG:
        for lang in langs.split():
            t = CLEAN[lang].replace("’", "'").replace("–", "-").replace("œ", "oe") if right != "utf-8" else CLEAN[lang]
            bad.add(len(out))
            origin[len(out)] = t
            out.append((len(out), garble(t, right, wrong)))
    for t in ("Great value � I paid", garble(garble("C’est déjà là", "utf-8", "cp1252"), "utf-8", "cp1252"), "a\u0092b", garble("café", "utf-8", "cp1252") + " and clean café"):
        bad.add(len(out))
        out.append((len(out), t))
    return out, bad, origin


@pytest.fixture(scope="module")
def corpus(spark):
    rows, bad, origin = docs()
    return spark.createDataFrame([*rows, (5000, None)], "doc_id long, text string"), bad, origin, dict(rows)


def test_found(corpus):
    df, bad, _, texts = corpus
    got = [r.doc_id for r in M.find_garbled(df).collect()]
    assert len(got) == len(set(got))
    assert {(i, texts[i]) for i in set(got) - bad} == set() and {(i, texts[i]) for i in bad - set(got)} == set()


def test_restored(corpus):
    df, bad, origin, texts = corpus
    got = {r.doc_id: r for r in M.restore(df).collect()}
    assert set(got) == bad
    share = [M.PIECE.findall(got[i].restored_text) == M.PIECE.findall(t) for i, t in origin.items()]
    assert sum(share) / len(share) >= 0.75, [(texts[i], got[i].restored_text) for i, t in origin.items() if got[i].restored_text != t]
    words = [(a, b) for i, t in origin.items() for a, b in zip(got[i].restored_text.split(), t.split())]
    assert sum(a == b for a, b in words) / len(words) >= 0.95


def test_search_prefers_plausible():
    best = lambda t: min(M.search(t), key=lambda x: x[1] + M.STEP * len(x[2].split()))[0]
    assert best("GrÃ¶ÃŸe") == "Größe"
    assert best("itÃ¢â‚¬â„¢s") == "it’s"
    assert best("Ã©tait") == "était"
    assert M._unescape("&eacute;t&eacute;") == "été" and M._unescape("AT&T") is None
    assert min(M.search("schön"), key=lambda x: x[1])[1] >= M.cost("schön") - M.MARGIN + 0.01


def test_cost_and_marks():
    assert M.cost("plain") == 0 and M.cost("") == 0
    assert M.cost("é") < M.cost("Ã©") and M.cost("что") < M.cost("Ñ‡Ñ‚Ð¾")
    assert M.marked("a�") and M.marked("\x92") and not M.marked("Ã“ ┤ 日")


def test_recode_round_trip():
    rng = random.Random(0)
    for _ in range(200):
        a, b = rng.sample(M.ENCODINGS, 2)
        t = "".join(rng.choice("aé ßÄłя") for _ in range(8))
        u = M._recode(t, a, b)
        if u is not None and "�" not in u:
            assert M._recode(u, b, a) == t


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 300_000), (2, "Ã©" * 20_000), (3, "déjà vu " * 10_000), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in M.find_garbled(df).collect()] == [2]
    assert M.find_garbled(df.limit(0)).count() == 0 and M.restore(df.limit(0)).count() == 0
