"""Text that was decoded with a wrong character encoding: which documents hold some, and what it read before.

Pieces of text with letters outside ASCII are reduced to their distinct forms over the corpus before anything is
searched.  From each form a best-first search goes over texts: an edge encodes with one character set and decodes with
another, or takes escapes off; texts seen before are skipped by hash, and the cheapest open text is taken next.  The
cost of a text is how implausible its characters are side by side.  To that comes how often the form occurs in the
whole corpus, by a join.  A form is garbled if it has marks that no right text has, or if a cheaper text was reached.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import lookup_join
from ..session import cut_lineage
from .common import spread

#: Character sets that text is taken for, and those that it is really in.  "utf-8" is only ever the real one.
ENCODINGS = ("latin-1", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac_roman")
WIDE_ENCODINGS = ("gbk", "big5", "shift_jis", "euc_kr")

#: A piece: ASCII letters and anything beyond ASCII; a no-break space only after such a character.
PIECE = re.compile(r"(?:[A-Za-z]|[^\x00-\x7f\xa0]|(?<=[^\x00-\x7f\xa0])\xa0)+")
ESCAPE = re.compile(r"&(?:amp;)*(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8}\d{0,2});|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")
#: Letters and escapes side by side: read as one text before pieces are cut, as one letter's bytes may be several escapes.
RUN = re.compile(rf"(?:{PIECE.pattern[3:-2]}|{ESCAPE.pattern})++")

#: A cheaper text must gain this much in cost, less if UTF-8 sequences were found, as those hardly arise by chance; a word
#: of the same cost must be 2**RARER times as frequent.  No frequency of its own speaks for a form with UTF-8 sequences
#: that gains STRONG, as such damage is as frequent as the word that it befalls.
MARGIN, UTF8_MARGIN, RARER, SHORTEST, STRONG = 1.5, 0.9, 4.0, 4, 3.0
DEEPEST = 4
#: Characters up to which a form is searched as a whole; a longer one is searched in stretches of that many, which overlap by
#: ``LAP``, for the steps that lead to something better, and these are then taken on all of it.
LONGEST, LAP = 64, 16
#: Garbled forms, and bytes of theirs, up to which the repairs are broadcast; more are joined by shuffle.
REPAIRS, REPAIR_BYTES = 200_000, 32 << 20


# ---- character plausibility -------------------------------------------------------------------------------------
@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """L, l: Latin capital, small; A, a: the same in ASCII; R, r: Russian; X: other letter; H: Han and kana;
    S: symbol; Q: punctuation of running text; D: digit; N: no-break space; C: combining mark; M: mark of damage;
    space: neutral."""
    o = ord(c)
    if o < 128:
        return "A" if c.isupper() else "a" if c.islower() else "D" if c.isdigit() else " "
    if o == 0xFFFD or 0x80 <= o <= 0x9F:
        return "M"
    cat = unicodedata.category(c)
    if cat in ("Co", "Cn", "Cs", "Cc"):
        return "M"
    if o == 0xA0:
        return "N"
    if cat in ("Mn", "Me") and not 0xFE00 <= o <= 0xFE0F:
        return "C"
    if cat in ("Cf", "Mn", "Zs") and o != 0xAD or 0x1F000 <= o <= 0x1FAFF or 0x2600 <= o <= 0x27BF or 0x2B00 <= o <= 0x2BFF:
        return " "
    if cat in ("Lu", "Ll", "Lt", "Lo") and o not in (0xAA, 0xBA, 0xB5):
        if 0xC0 <= o <= 0x17F:
            return "l" if cat == "Ll" else "L"
        if 0x410 <= o <= 0x44F or o in (0x401, 0x451):
            return "R" if cat == "Lu" else "r"
        return "H" if 0x2E80 <= o <= 0xD7FF or 0xF900 <= o <= 0xFFEF else "X"
    return "Q" if c in "“”„‘’«»‹›…–—¡¿€·" else "S"


LATIN, RUSSIAN = frozenset("LlAa"), frozenset("Rr")
LETTERS = frozenset("LlAaRrXH")
UPPER, LOWER = frozenset("LAR"), frozenset("lar")
BEFORE, AFTER = frozenset("“„‘«‹¡¿—–…€”»’"), frozenset("”’»›…–—“€·‘")  # quotes and dashes that may stand before, after a word
BASE = {"L": 1.0, "l": 1.0, "R": 0.35, "r": 0.3, "X": 1.6, "H": 1.5, "S": 0.5, "Q": 0.3, "N": 1.0, "C": 2.0, "M": 6.0}
#: What each further step costs among texts reached.
STEP = 0.9


def cost(text: str) -> float:
    """How implausible the characters of a text are in their order; 0 for ASCII."""
    kinds = [_kind(c) for c in text]
    total, n, mixed = 0.0, len(text), {k in LATIN for k in kinds if k in LETTERS}
    if len(mixed) > 1:  # two scripts in one piece
        total += 3.0 * max(1, sum(a in LETTERS and b in LETTERS and (a in LATIN) != (b in LATIN) for a, b in zip(kinds, kinds[1:])))
    for i, k in enumerate(kinds):
        before, after = kinds[i - 1] if i else " ", kinds[i + 1] if i + 1 < n else " "
        total += BASE.get(k, 0.0)
        if k in LETTERS:
            if k in UPPER and before in LOWER and (k != "A" or i > 1):
                total += 2.5 if k != "A" or before != "a" else 0.3
            if k in "Ll" and before in "Ll":
                total += 0.4
            if k == "X" and before in RUSSIAN:
                total += 0.5
        elif k == "S":
            if before in LETTERS:
                total += 2.5 if after in LETTERS or text[i] not in "²³°™®©ªº" else 0.7
            if after in LETTERS and text[i] not in "µ§№©°":
                total += 1.5
            if 0x2500 <= ord(text[i]) <= 0x259F and (before in LETTERS or after in LETTERS):
                total += 1.5
            if before in "SQ" and text[i - 1] != text[i]:
                total += 1.2
        elif k == "Q":
            if before in LETTERS and after in LETTERS:
                total += {"’": 0.0, "·": 1.0, "—": 1.2, "–": 1.2}.get(text[i], 2.5)
            elif after in LETTERS and text[i] not in BEFORE or before in LETTERS and text[i] not in AFTER:
                total += 2.0
    return total


def marked(text: str) -> bool:
    """True if the text has characters that no right text has."""
    return any(_kind(c) == "M" for c in text)


# ---- edges ------------------------------------------------------------------------------------------------------
@lru_cache(64)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Byte of each character of a one-byte set; bytes that the set leaves out stand for the control of that number."""
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(64)
def _chars_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in _bytes_of(encoding).items()}


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _utf8_inside(text: str, encoding: str) -> str | None:
    """The text with every UTF-8 sequence read as one, where its characters stand for bytes of the set; None if none."""
    table, out, run, hit = _bytes_of(encoding), [], [], False

    def flush() -> None:
        nonlocal hit
        if run:
            raw, at = bytes(table[c] for c in run), 0
            for m in _UTF8.finditer(raw):
                try:
                    c = m.group().decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out.append("".join(run[at : m.start()]) + c)
                at, hit = m.end(), True
            out.append("".join(run[at:]))
            run.clear()

    for c in text:
        if c in table:
            run.append(c)
        else:
            flush()
            out.append(c)
    flush()
    return "".join(out) if hit else None


def _recode(text: str, wrong: str, right: str) -> str | None:
    """Bytes of one one-byte set read as another's; None if the text has other characters."""
    table, chars, out = _bytes_of(wrong), _chars_of(right), []
    for c in text:
        if ord(c) < 128:
            out.append(c)
        elif c in table:
            out.append(chars.get(table[c], "�"))
        else:
            return None
    return "".join(out)


def _one_escape(m: re.Match) -> str:
    e = m.group()
    if e[0] == "&":  # also escaped several times over
        return html.unescape("&" + e[1:].replace("amp;", "", e.count("amp;") - (e[-4:] == "amp;")))
    if len(e) == 12:  # two halves of one character
        return (chr(int(e[2:6], 16)) + chr(int(e[8:], 16))).encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    c = chr(int(e[2:], 16))
    return e if "\ud800" <= c <= "\udfff" else c


def _unescape(text: str) -> str | None:
    out = ESCAPE.sub(_one_escape, text)
    return out if out != text else None


def edges(text: str, last: str = "") -> Iterator[tuple[str, str]]:
    """(operation, text) of every step from a text that ``last`` led to.  Two steps in a row between one-byte sets are one
    of another pair, and reading the bytes back that such a step wrote undoes it, so neither is taken."""
    recoded = last.partition(">")[2] if last and last != "unescape" and not last.endswith("utf-8") else None
    if "&" in text or "\\" in text:
        t = _unescape(text)
        if t is not None:
            yield "unescape", t
    for e in ENCODINGS:
        t = _utf8_inside(text, e) if e != recoded else None
        if t is not None:
            yield f"{e}>utf-8", t
    if recoded:
        return
    if any(_kind(c) == "H" for c in text):
        for e in WIDE_ENCODINGS:
            try:
                yield f"{e}>utf-8", text.encode(e).decode("utf-8")
            except UnicodeError:
                pass
    for wrong in ENCODINGS:
        if _recode(text, wrong, "latin-1") is not None:
            for right in ENCODINGS:
                if right != wrong:
                    yield f"{wrong}>{right}", _recode(text, wrong, right)


def _lead(text: str) -> bool:
    """Whether the text may hold a UTF-8 sequence read in some one-byte set."""
    return any(a in _LEADS and b in _TRAILS for a, b in zip(text, text[1:]))


_LEADS = frozenset(c for e in ENCODINGS for c, b in _bytes_of(e).items() if b >= 0xC2)
_TRAILS = frozenset(c for e in ENCODINGS for c, b in _bytes_of(e).items() if b < 0xC0)


def search(text: str) -> list[tuple[str, float, str]]:
    """All texts within reach that cost at most 0.8 more than the start, (text, cost, operations), the cheapest first; the
    start is among them.  Which of them is right is for their frequency to say, so none is left out here."""
    return _search(text) if len(text) <= LONGEST else _search_long(text)


def _search(text: str) -> list[tuple[str, float, str]]:
    """Best-first: the open text of least cost is expanded next, until none is open; texts deeper than DEEPEST steps and
    dearer than the start are not followed.  A text after a step between one-byte sets is dear by nature if it holds UTF-8
    sequences, so it is read on at once, whatever it costs."""
    start = cost(text)
    seen, heap = {text: (start, "")}, [(start, 0, text)]

    def reach(op: str, u: str, ops: str, depth: int) -> None:
        cu = cost(u)
        seen[u] = (cu, f"{ops} {op}".strip())
        if ">utf-8" in op or op == "unescape":
            heapq.heappush(heap, (cu, depth, u))
        elif _lead(u):
            for again, v in edges(u, op):
                if v not in seen:
                    reach(again, v, seen[u][1], depth + 1)

    while heap:
        c, depth, t = heapq.heappop(heap)
        if depth >= DEEPEST or depth and c > start + 0.5:
            continue
        for op, u in edges(t):
            if u not in seen:
                reach(op, u, seen[t][1], depth + 1)
    best = sorted((cu, len(ops), u, ops) for u, (cu, ops) in seen.items() if cu <= start + 0.8)
    return [(u, cu, ops) for cu, _, u, ops in best]


def _take(text: str, op: str) -> str | None:
    """One named step on a text of any length; None if it can't be taken."""
    if op == "unescape":
        return _unescape(text)
    wrong, right = op.split(">")
    if right != "utf-8":
        return _recode(text, wrong, right)
    if wrong not in WIDE_ENCODINGS:
        return _utf8_inside(text, wrong)
    try:
        return text.encode(wrong).decode("utf-8")
    except UnicodeError:
        return None


def _search_long(text: str) -> list[tuple[str, float, str]]:
    """Whatever steps lead some stretch to a cheaper text are taken on the whole; no stretch is left out and none is cut off
    from what it belongs to, as only the steps are learnt from stretches."""
    paths, stretches = {}, {text[i : i + LONGEST] for i in range(0, len(text), LONGEST - LAP)}
    for part in stretches:
        was = cost(part)
        for _, c, ops in _search(part):
            if ops and c < was - 0.5:
                paths[ops] = None
    start = cost(text)
    out = {text: (start, "")}
    for ops in sorted(paths, key=lambda o: (o.count(" "), o)):
        t: str | None = text
        for op in ops.split(" "):
            t = _take(t, op) if t is not None else None
        if t is not None and t not in out:
            out[t] = (cost(t), ops)
    best = sorted((c, len(ops), u, ops) for u, (c, ops) in out.items() if c <= start + 0.8)
    return [(u, c, ops) for c, _, u, ops in best]


# ---- operator ---------------------------------------------------------------------------------------------------
def plain_pieces(text: str) -> set[str]:
    return {p for p in PIECE.findall(text) if not p.isascii()}


def escaped_pieces(run: str) -> set[str]:
    """Pieces that a run has only once its escapes are taken off, the first step of their search.  Escapes of marks alone
    are no damage, as the text itself shows none; those that make UTF-8 sequences are."""
    found = plain_pieces(_unescape(run) or "") - plain_pieces(run)
    return {q for q in found if not marked(q) or any(_utf8_inside(q, e) for e in ENCODINGS)}


def pieces_of(text: str | None) -> set[str]:
    """Distinct pieces of a text that hold something beyond ASCII, also after its escapes are taken off."""
    if not text or text.isascii() and "&" not in text and "\\" not in text:
        return set()
    found = plain_pieces(text)
    if "&" in text or "\\" in text:
        for run in RUN.findall(text):
            if "&" in run or "\\" in run:
                found |= escaped_pieces(run)
    return found


def doc_pieces(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, piece): the distinct pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = sorted(pieces_of(t))
                at += [i] * len(found)
                out += found
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string())], [doc_id, "piece"])

    src = spread(docs.select(doc_id, text), doc_id)
    # used by the count of forms and by the join back: written once, so that texts are read once
    return cut_lineage(src.mapInArrow(run, f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, piece string"))


def garbled_pieces(pieces: DataFrame, doc_id: str) -> DataFrame:
    """(piece, restored, operations): the garbled forms; restored is null where nothing cheaper was reached."""
    spark = pieces.sparkSession
    forms = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    frequency = forms.groupBy(F.lower("piece").alias("_form")).agg(F.sum("n").alias("_df"), F.max_by("piece", F.struct("n", "piece")).alias("_usual"))
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, marked(p), u, c, ops) for p in b.column(0).to_pylist() for u, c, ops in search(p)]
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.bool_(), pa.string(), pa.float64(), pa.string()]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types)], ["piece", "marked", "reached", "cost", "operations"])

    found = forms.select("piece").repartition(tasks, "piece").mapInArrow(run, "piece string, marked boolean, reached string, cost double, operations string")
    found = found.join(frequency, F.lower("reached") == F.col("_form"), "left")
    often = F.log2(F.coalesce("_df", F.lit(0)) + 1.0)  # ranks what was reached; as evidence only if both forms are long
    own = F.col("operations") == ""
    rows = found.select("piece", "marked", "reached", "cost", "operations", often.alias("often"), own.alias("own"), F.coalesce(F.col("reached") != F.col("_usual"), F.lit(True)).alias("unusual"))
    # a UTF-8 sequence before or after a step between one-byte sets comes about by chance too often: only frequency speaks for it
    mixed = F.col("operations").rlike(r">(?!utf-8)") & F.col("operations").contains("utf-8")
    rank = F.struct((F.col("cost") - 0.5 * F.col("often") + STEP * F.size(F.split("operations", " "))).alias("k"), "unusual", "reached", "cost", "often", "operations")
    each = rows.groupBy("piece").agg(
        F.max("marked").alias("marked"),
        F.max(F.when(F.col("own"), F.struct("cost", "often"))).alias("was"),
        F.min(F.when(~F.col("own") & ~mixed, rank)).alias("best"),
        F.min(F.when(~F.col("own") & mixed, rank)).alias("far"),
    )

    def gain(x: str) -> Column:
        return F.col("was.cost") - F.col(f"{x}.cost")

    def rarer(x: str) -> Column:
        both = F.least(F.length("piece"), F.length(f"{x}.reached")) >= SHORTEST
        return F.when(both, F.col(f"{x}.often") - F.col("was.often")).otherwise(0.0)

    utf8 = F.col("best.operations").contains("utf-8")
    plain = (gain("best") >= F.when(utf8, UTF8_MARGIN).otherwise(MARGIN)) & ((rarer("best") > -RARER) | utf8 & (gain("best") >= STRONG))
    common = {x: (gain(x) > -0.8) & (rarer(x) >= RARER) for x in ("best", "far")}
    near, far = F.coalesce(plain | common["best"], F.lit(False)), F.coalesce(common["far"], F.lit(False))
    out = {c: F.when(near, F.col(f"best.{c}")).when(far, F.col(f"far.{c}")) for c in ("reached", "operations")}
    return each.where(F.col("marked") | near | far).select("piece", out["reached"].alias("restored"), out["operations"].alias("operations"))


def _bounded(repairs: DataFrame) -> bool:
    """Whether the repairs are few enough to be broadcast: counted, in rows and bytes."""
    size = F.sum(F.octet_length("piece") + F.coalesce(F.octet_length("restored"), F.lit(0)))
    n, size = repairs.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return n <= REPAIRS and size <= REPAIR_BYTES


def find_garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id): documents whose text has at least one garbled piece.  Null and empty texts have none.

    The garbled forms are broadcast if a count proves them small, else joined by shuffle with each form spread over
    several parts, as very many documents may hold one.
    """
    pieces = doc_pieces(docs, doc_id, text)
    repairs = cut_lineage(garbled_pieces(pieces, doc_id))
    bad = repairs.select(F.col("piece").alias("_piece"))
    rows = REPAIRS if _bounded(repairs) else -1
    return lookup_join(pieces, bad, ["piece"], ["_piece"], "left_semi", doc_id, rows).select(doc_id).distinct()


def restore_text(text: str, repairs: dict[str, str | None], operations: list[str]) -> str:
    """Repair the pieces named; where one one-byte step repaired most of them, it is also tried on the others."""
    votes = Counter(o for o in operations if o and " " not in o and not o.endswith("utf-8") and o != "unescape")
    step = votes.most_common(1)[0][0].split(">") if votes else None

    def one(p: str) -> str:
        if repairs.get(p):
            return repairs[p]
        if step and not p.isascii() and p not in repairs:
            u = _recode(p, *step)
            if u is not None and not marked(u) and cost(u) <= cost(p) + 0.3:
                return u
        return p

    def whole(t: str) -> str:
        return PIECE.sub(lambda m: one(m.group()), t)

    if "&" not in text and "\\" not in text:
        return whole(text)
    out, at = [], 0
    for m in RUN.finditer(text):  # escapes stay where nothing under them is repaired
        run = m.group()
        under = ("&" in run or "\\" in run) and any(repairs.get(q) for q in escaped_pieces(run))
        out += [text[at : m.start()], whole(_unescape(run) if under else run)]
        at = m.end()
    return "".join([*out, text[at:]])


def restore(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored_text, n_pieces, n_restored) of the garbled documents; what cannot be restored stays.

    Repairs that a count proves small are broadcast, and no text is shuffled.  More are joined to the pieces of the
    documents, and only then do texts meet them by shuffle.
    """
    pieces = doc_pieces(docs, doc_id, text)
    repairs = cut_lineage(garbled_pieces(pieces, doc_id))
    types = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, restored_text string, n_pieces long, n_restored long"

    def batch(ids: list, texts: list, found: list[list[tuple]]) -> pa.RecordBatch:
        out = [restore_text(t, {p: u for p, u, _ in rs}, [o for _, _, o in rs]) for t, rs in zip(texts, found)]
        ok = [sum(u is not None for _, u, _ in rs) for rs in found]
        return pa.record_batch([ids, pa.array(out, pa.string()), pa.array(list(map(len, found)), pa.int64()), pa.array(ok, pa.int64())], [doc_id, "restored_text", "n_pieces", "n_restored"])

    if _bounded(repairs):
        shared = docs.sparkSession.sparkContext.broadcast({r["piece"]: tuple(r) for r in repairs.collect()})

        def search_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).to_pylist()
                found = [[shared.value[p] for p in sorted(pieces_of(t) & shared.value.keys())] for t in texts]
                at = [i for i, rs in enumerate(found) if rs]
                yield batch(b.column(0).take(pa.array(at, pa.int64())), [texts[i] for i in at], [found[i] for i in at])

        return spread(docs.select(doc_id, text), doc_id).mapInArrow(search_here, types)
    named = repairs.select(F.col("piece").alias("_piece"), "restored", "operations")
    bad = lookup_join(pieces, named, ["piece"], ["_piece"], "inner", doc_id, -1).groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("piece", "restored", "operations"))).alias("_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[(r["piece"], r["restored"], r["operations"]) for r in rs] for rs in b.column(2).to_pylist()]
            yield batch(b.column(0), b.column(1).to_pylist(), found)

    return docs.select(doc_id, text).join(bad, doc_id).mapInArrow(run, types)
