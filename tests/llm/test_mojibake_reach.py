"""Right readings that are not among the cheapest by their characters."""

from spanloom.llm import mojibake as M


def test_right_reading_is_reached_and_chosen(spark):
    """Damaged form -> right one; the corpus has the right one often, and it is sixth or later by cost."""
    want = {"Fьr": "Für", "Bьro": "Büro", "ьblich": "üblich", "цffnen": "öffnen", "H÷he": "Höhe"}
    reached = {g: [u for u, _, _ in M.search(g)] for g in want}
    assert [g for g, w in want.items() if w not in reached[g]] == []
    rows = [(100 * k + i, w) for k, w in enumerate(want.values()) for i in range(60)]
    bad = [(9000 + k, g) for k, g in enumerate(want)]
    df = spark.createDataFrame(rows + bad, "doc_id long, text string")
    assert {r.doc_id: r.restored_text for r in M.restore(df).collect()} == dict(zip((k for k, _ in bad), want.values()))


def test_search_ends_on_any_text():
    for t in ("Ãƒ" * 32, "Ã©Â€" * 16, "РѓС‚" * 16, "ä" * 64, "ďż˝" * 21):
        assert t in [u for u, _, _ in M.search(t)] and len(M.search(t)) < 2000


def test_long_pieces_are_not_cut(spark):
    """Scripts without spaces give pieces of any length; a cut would fall into sequences of bytes."""
    han = "这个产品的质量非常好我很满意下次还会再来购买谢谢老板送货速度也很快" * 40
    right = {1: han, 2: "a" + han[:61], 3: "ждём" * 5_000, 4: "x" + "日本語" * 90}
    bad = {k: t.encode().decode("latin-1") for k, t in right.items()}
    rows = [*bad.items(), *((10 + k, t) for k, t in right.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.restored_text for r in M.restore(df).collect()} == right


def test_steps_between_one_byte_sets_go_on():
    """UTF-8 read in one set, written in a second, read in a third."""
    for e, written, read in (("latin-1", "cp850", "cp1252"), ("cp1252", "cp850", "latin-1")):
        t = "".join(M._chars_of(read)[M._bytes_of(written)[c]] if ord(c) > 127 else c for c in "täglich".encode().decode(e))
        assert "täglich" in [u for u, _, _ in M.search(t)]


def test_both_ways_of_joining_repairs_agree(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(["fÃ¼r mich fÃ¼r", "für", "cafÃ© dÃ©jÃ", None, "", "a\ufffdb"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, M.restore(df).collect())), sorted(map(tuple, M.find_garbled(df).collect()))
    monkeypatch.setattr(M, "REPAIR_BYTES", 3)
    assert (sorted(map(tuple, M.restore(df).collect())), sorted(map(tuple, M.find_garbled(df).collect()))) == want and want[0]
