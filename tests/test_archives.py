"""Archives by the table function: members, lines, broken and empty content."""

import io
import zipfile

from millwright.sources import archives as A


def test_lines_of_members(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a/NCR_1.json", '{"k": 1}\n{"k": "é"}\r\n')
        z.writestr("dir/", "")
        z.writestr("Report.csv", "x,y")
        z.writestr("long.txt", "z" * (A.MOST_LINE + 5))
        z.writestr("empty.txt", "")
    good = raw.getvalue()
    rows = [("good", good), ("cut", good[: len(good) // 2]), ("text", b"no archive"), ("none", None), ("empty", b"")]
    got = {}
    for r in A.archive_lines(spark.createDataFrame(rows, "name string, content binary")).collect():
        got.setdefault(r["name"], []).append((r.member, r.line_no, len(r.line or ""), r.kind))
    assert got["good"] == [("a/NCR_1.json", 1, 8, "ncr"), ("a/NCR_1.json", 2, 10, "ncr"), ("Report.csv", 1, 3, "report"), ("long.txt", 1, A.MOST_LINE, "other"), ("long.txt", 2, 5, "other")]
    assert got["text"] == got["cut"] == [(None, None, 0, "broken")] and "none" not in got and "empty" not in got


def test_small_members_are_not_compressed_and_broken_ones_keep_their_first_lines():
    raw = A.pack_members([("a/NCR_1.json", '{"k": 1}\né\n'), ("long.txt", "z\n" * 5000)])
    infos = zipfile.ZipFile(io.BytesIO(raw)).infolist()
    assert [i.compress_type for i in infos] == [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED]
    lines = lambda content: list(A.ArchiveLines.func().eval(content))
    got = lines(raw)
    assert got[:2] == [("a/NCR_1.json", 1, '{"k": 1}'), ("a/NCR_1.json", 2, "é")] and got[2:] == [("long.txt", n + 1, "z") for n in range(5000)]
    at = raw.index(b'{"k": 1}')
    assert lines(raw[:at] + b'{"k": 2}' + raw[at + 8 :])[-1] == ("a/NCR_1.json", None, None)
    reads, real = [], zipfile.ZipFile.open
    zipfile.ZipFile.open = lambda z, *a, **k: reads.append(1) or real(z, *a, **k)
    try:
        list(A._opened(zipfile.ZipFile(io.BytesIO(raw)), infos[0]))
    finally:
        zipfile.ZipFile.open = real
    assert len(reads) == 1
