import random

import pytest

from quarrylight.llm import splitting as s

ROWS = "id string, file_id long, rel_path string, ext string, start_line int, end_line int, content string, metadata string, piece int, _key string"


def walk(text, limit, overlap):
    """The same cuts by a walk from one to the next."""
    import numpy as np

    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    b = s.boundaries(raw, max(8, (limit - overlap * 5) // 4))
    start = s.begins(raw, b, overlap) if overlap else b
    at, out = 0, []
    while at < len(b) - 1:
        to = max(k for k in range(len(b)) if b[k] - start[at] <= limit)
        out.append((int(start[at]), int(b[to])))
        at = to
    return out


def texts():
    rnd = random.Random(2)
    yield "".join("w" * rnd.randint(1, 9) + rnd.choice(" \n") for _ in range(3000))
    yield "é" * 9000
    yield "\r\n".join("line %d" % i for i in range(2000))
    yield "x" * 5000 + "\n" + "y z " * 3000
    yield "𝄞a" * 4000


@pytest.mark.parametrize("text", list(texts()))
@pytest.mark.parametrize(("limit", "overlap"), [(2048, 40), (1024, 0), (4000, 200), (2048, 390)])
def test_pieces(text, limit, overlap):
    raw = text.encode()
    got = s.cut(text, limit, overlap)
    assert got == walk(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(raw)
    for a, b in got:
        assert b - a <= limit
        raw[a:b].decode()
    for (_, e), (a, _) in zip(got, got[1:], strict=False):
        shared = len(raw[a:e].decode())
        assert 0 <= shared <= overlap * 6 // 5 and (not overlap or shared >= overlap * 4 // 5)
        assert raw[e - 1 : e + 1] != b"\r\n"


def test_cuts_fall_on_line_ends_where_there_are_any():
    text = "".join(f"line number {i}\n" for i in range(3000))
    assert all(text.encode()[e - 1 : e] == b"\n" for _, e in s.cut(text))


def test_rows(spark):
    big = "".join(f"line {i}\n" for i in range(4000))
    rows = [("a", 1, "a.py", "py", 11, None, big, None, 7, "k"), ("a", 1, "a.py", "py", 11, None, big, None, 7, "k"), ("s", None, None, None, None, 1, "small", "{}", 0, ""), ("n", 1, "", "", 1, 1, None, "", 0, ""), ("e", 1, "", "", 1, 1, "", "", 0, ""), (None, 1, "", "", None, None, big, "", 0, "")]
    df = spark.createDataFrame(rows, ROWS)
    got = s.split_pieces(s.distinct_rows(df)).collect()
    a = sorted((r for r in got if r.id == "a"), key=lambda r: r.piece)
    assert len(a) > 2 and a[0].start_line == 11 and a[-1].end_line == 11 + 4000 - 1
    for r in a:
        first = int(r.content.split("\n")[0].split()[1])
        assert r.start_line == 11 + first and r.end_line - r.start_line + 1 == r.content.count("\n")
    assert [(r.id, r.content, r.start_line, r.end_line) for r in got if r.id in ("s", "e", "n")] in ([("s", "small", 1, 1), ("e", "", 1, 1)], [("e", "", 1, 1), ("s", "small", 1, 1)])
    assert s.split_pieces(spark.createDataFrame([], ROWS)).count() == 0
    assert s.oversized(df).where("id is null").count() == 1
    with pytest.raises(ValueError):
        s.split_pieces(df, 100, 50)
    assert [tuple(r) for r in s.checks(s.split_pieces(df.where("id = 'a'").limit(1))).collect()] == [("a", len(big), True, True, True)]
    mixed = spark.createDataFrame([(None, 1, "a", "", 1, 1, "x", "", 0, ""), ("a", 1, None, "", 1, 1, "x", "", 0, "")], ROWS)
    assert s.distinct_rows(mixed).count() == 2  # nulls are told apart
