"""Damage that is frequent in the corpus, as that of frequent words is."""

from spanloom.llm import mojibake as M

#: Short words, whose repair has under M.SHORTEST letters, and long ones whose repair the corpus never holds.
RIGHT = ["für", "más", "não", "I’m", "się", "не", "что", "Größe", "después"]


def garble(text, wrong):
    return "".join(bytes([b]).decode(wrong, "replace") if wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())


def test_frequent_damage_is_found(spark):
    rows = [(k, f"{RIGHT[k % 7]} {k}") for k in range(2000)]
    bad = {}
    for word in RIGHT:
        for wrong in ("cp1252", "latin-1"):
            for _ in range(40):
                bad[10_000 + len(bad)] = (garble(word, wrong), word)
    df = spark.createDataFrame(rows + [(k, g) for k, (g, _) in bad.items()], "doc_id long, text string")
    assert {r.doc_id for r in M.find_garbled(df).collect()} == set(bad)
    assert {r.doc_id: r.restored_text for r in M.restore(df).collect()} == {k: w for k, (_, w) in bad.items()}


def test_frequent_right_word_stays(spark):
    """A frequent word whose letters happen to make a UTF-8 sequence in some set gains little by it."""
    df = spark.createDataFrame([(k, f"потому {k}") for k in range(100)], "doc_id long, text string")
    assert M.find_garbled(df).count() == 0
