import duckdb
import pytest

from filescope.llm import lines


def split(text):
    """Units by hand: up to and with a newline, or a mark and a space."""
    out, now = [], ""
    for c in text:
        now += c
        if c == "\n" or (c == " " and len(now) > 1 and now[-2] in ".!?"):
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def words(unit):
    for c in "\t\n\r\x0b\x0c":
        unit = unit.replace(c, " ")
    return [w for w in unit.split(" ") if w]


def brute(rows, least=lines.WORDS, run=lines.RUN):
    """Kept text and removed (start, length) of each (doc_id, text), in rank order."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        parts = split(text or "")
        state = []  # None: too short, else whether it was seen before
        for unit in parts:
            key = " ".join(words(unit.lower()))
            state.append(None if len(words(unit)) < least else key in seen)
            if len(words(unit)) >= least:
                seen.add(key)
        gone = set()
        known = [i for i, s in enumerate(state) if s is not None]
        i = 0
        while i < len(known):
            j = i
            while j < len(known) and state[known[j]]:
                j += 1
            if j > i and sum(len(words(parts[k])) for k in known[i:j]) >= run:
                gone |= set(range(known[i], known[j - 1] + 1))
            i = max(j, i + 1)
        spans, at, kept = [], 0, ""
        for k, unit in enumerate(parts):
            if k in gone:
                if k - 1 in gone:
                    spans[-1] = (spans[-1][0], spans[-1][1] + len(unit))
                else:
                    spans.append((at, len(unit)))
            else:
                kept += unit
            at += len(unit)
        out[doc] = (None if text is None else kept, spans, len(parts), len(gone))
    return out


A = "This is the first sentence of a passage that repeats in other texts. "
B = "And here the second one follows it with its many words! "
C = "Is there a third one too? "
SHORT = "Oh no. "


@pytest.fixture(scope="module")
def table():
    rows = [(5, f"Lead in here it is. {A}{B}{SHORT}{C}The end comes with a few other words."), (2, f"{A}{B}{C}"), (9, None), (7, ""), (8, f"{A}\n" * 300), (1, "\n\n"), (None, f"x {C.upper()}"), (11, f"{SHORT}{A}{SHORT}"), (12, f"{SHORT}{A}{B}{SHORT}\n \t{SHORT}{C} é😀 {A}"), (13, "é😀 a b c d\n" * 7), (14, f"{C}" * 3 + "."), (15, f"{A.upper()}\t{B}"), (16, f"{A}{B}".replace(" ", "  ")), (17, "no mark at all and not one line more " * 40)]
    return [*rows, (18, rows[-1][1]), (19, "no end. " * 50), (20, "no end. " * 50)]


def test_against_brute_force(spark, table):
    df = spark.createDataFrame([(a, b, "clash") for a, b in [*table, table[0]]], "doc_id long, text string, digest string")
    for least, run in ((lines.WORDS, lines.RUN), (1, 1), (2, 30)):
        out = lines.deduplicate(df.repartition(3), words=least, run=run).collect()
        want = brute(table, least, run)
        assert len(out) == len(table) + 1
        for r in out:
            kept, spans, n, gone = want[r["doc_id"]]
            assert ([tuple(s) for s in r["spans"]], r["kept_text"], r["n_units"], r["n_removed"], r["removed_chars"]) == (spans, kept, n, gone, sum(x for _, x in spans)), r["doc_id"]
    assert lines.digests(lines.deduplicate(df.limit(0))).count() == 0


def test_a_passage_inside_a_line_goes_and_short_lines_stay(spark):
    passage = A + B + C
    rows = [(1, f"Some text of its own comes before it. {passage}And some after it."), (2, f"Quite another text starts here. {passage}And it ends.\nAll rights reserved by us.\nThank you."), (3, "A third text.\nAll rights reserved by us.\nThank you.")]
    out = {r["doc_id"]: r["kept_text"] for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: rows[1][1].replace(passage, ""), 3: rows[2][1]}


def test_sql(spark, table):
    con = duckdb.connect()
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.createDataFrame([r for r in table if r[0] is not None], "doc_id long, text string")):
        ours = sorted(tuple(r) for r in lines.digests(lines.deduplicate(docs)).collect())
        con.register("documents", docs.select("doc_id", "text").toPandas())
        assert ours == sorted(con.sql(lines.ORACLE).fetchall())


def test_null_and_clashing_ids_with_different_texts(spark):
    passage, unique = (A + B + C).strip(), "Only this text has these many words of its own and none of them are anywhere else but here in this one line of it all"
    for key in (None, 7):
        rows = [(1, f"{passage}\nEnd one."), (key, f"{passage}\nEnd two."), (key, f"{unique}\nEnd three."), (key, f"{unique} too\nEnd four.")]
        out = sorted(r["kept_text"] for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
        gone = [t.removeprefix(f"{passage}\n") for _, t in rows]
        # Of the passage the earliest stays: nulls come first, 7 after 1.
        assert out == sorted([*gone[2:], *([gone[0], rows[1][1]] if key is None else [rows[0][1], gone[1]])])
