"""Damage written as entities or escapes."""

import time

from spanloom.llm import mojibake as M

BAD = {
    "un caf&Atilde;&copy; noir": "un café noir",
    "Gr&Atilde;&para;&Atilde;\u0178e": "Größe",
    "f&#195;&#188;r &amp; mehr": "für &amp; mehr",
    "f&#xC3;&frac14;r": "für",
    r"caf\u00c3\u00a9": "café",
    r"caf\xc3\xa9s": "cafés",
    r"it\u00e2\u0080\u0099s": "it’s",
    "caf&amp;Atilde;&amp;copy;": "café",
    "&Atilde;&copy;t&Atilde;&copy;": "été",
}
GOOD = ["caf&eacute; &amp; th&eacute;", "AT&amp;T &lt;b&gt;", r"C:\users\xavier \x90\x90 \u0041", r"smile \ud83d\ude00 and half \ud83d.", r"caf\u00e9", "R&D; a &nosuch; b", "&amp;eacute;", "x &#99999999; y"]


def test_escaped_damage(spark):
    rows = [(k, t) for k, t in enumerate([*BAD, *GOOD])] + [(1000 + k, f"café für Größe été it’s cafés {k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    assert {texts[r.doc_id] for r in M.find_garbled(df).collect()} == set(BAD)
    assert {texts[r.doc_id]: r.restored_text for r in M.restore(df).collect()} == BAD


def test_unescape_and_long_runs():
    assert M._unescape(r"\ud83d\ude00") == "😀" and M._unescape(r"\ud83d") is None and M._unescape("&amp;amp;") == "&"
    start = time.time()
    for t in ("a" * 100_000 + "&", "&amp;" * 20_000, r"\u00c3" * 20_000, "é" * 100_000 + "&x", "x&" * 50_000):
        M.pieces_of(t)
    assert time.time() - start < 10
