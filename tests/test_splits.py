"""Files read in splits give the grid that reading them whole gives."""

import random

import pytest

from tablewise.sources import grid, splits

PIECES = ["a", "bb", "编号", "é", "🙂", "ઊ", "Ċ", "਀", '"', '""', ",", ";", "\t", "\n", "\r\n", " ", "x\ny", '"q, ""z""\nend"', ',"",', " ", "\r"]


def both(spark, folder, split_bytes, pattern="*"):
    whole = grid.read_grid(grid.list_files(spark, str(folder), pattern))
    parts = splits.read_split_grid(spark, str(folder), pattern, split_bytes)
    return [sorted((r["source_file"], r["row_no"], r["sheet"], r["cells"]) for r in df.collect()) for df in (whole, parts)]


def rejects(spark, folder, split_bytes):
    found = (grid.unreadable_files(grid.list_files(spark, str(folder))), splits.unreadable_splits(spark, str(folder), "*", split_bytes))
    return [sorted(map(tuple, df.collect())) for df in found]


@pytest.mark.parametrize("split_bytes", [23, 300])
def test_random_files_in_splits_equal_whole_files(spark, tmp_path, split_bytes):
    draw = random.Random(split_bytes)
    for n in range(15):
        text = "".join(draw.choices(PIECES, k=draw.choice([1, 20, 120])))
        if n % 3 == 0:  # mostly well formed
            text = "".join(draw.choice(['k%d,"v\n%d",\n', "%d;%d\r\n", '"a""b%d",c%d\n', "\n"]).replace("%d", str(i)) for i in range(60))
        codec = ("utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "gb18030")[n % 5]
        mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(codec, b"")
        (tmp_path / f"f{n}.csv").write_bytes(mark + text.encode(codec))
    whole, parts = both(spark, tmp_path, split_bytes)
    assert len(whole) > 100 and whole == parts


def test_odd_files(spark, tmp_path):
    files = {
        "empty.csv": b"", "feed.csv": b"\n", "feeds.csv": b"\n\n\n", "none.csv": b"a", "bad.csv": b"a,b\n\xff\xff\x80\n", "zip.csv": b"PK\x03\x04ab\n",
        "book.xlsx": b"a\n", "odd16.csv": "a\nb\n".encode("utf-16") + b"x", "half16.csv": b"\xff\xfea\x00\n\x00\x00\xd8\n\x00",
        "mark_only.csv": b"\xef\xbb\xbf", "mark16.csv": b"\xff\xfe", "gb_mark.csv": b'\xef\xbb\xbfA,"x\n"\n\xc4\xe3\n', "gb_no_mark.csv": b'\xef\xbb\xbf"x"\n\xc4\xe3\n',
        "late_bad.csv": b"a,b\n" * 50 + b"\xc4\xe3\n" + "é".encode() * 3 + b"\xff\n", "open.csv": b'a,"never\nclosed\n\nat all', "cr.csv": b"a,b\rc,d\r\r\ne",
        "quotes.csv": b'a"b,"c"d"\n"",""""\n"x\r\ny"\r\n', ".hidden_like.csv.txt": b"1;2\n", "no ending": b"x y,z\n",
        "wide.csv": b"1,2\n3,4,5,6\n", "tabs.csv": b"\t\t\na;b\n" + b"\n" * 30 + b"c;d;e\n", "long.csv": b'x,"' + b"line\n" * 400 + b'",y\nz\n',
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for size in (37, 10_000):
        whole, parts = both(spark, tmp_path, size)
        assert ([r for r in whole if r not in parts], [r for r in parts if r not in whole]) == ([], []) and len(whole) == len(parts)
        one, two = rejects(spark, tmp_path, size)
        assert one == two and len(one) >= 6


def test_states_compose():
    """A split's map tells how it ends for either start."""
    import numpy as np

    text = b'1,"a\n2"\n3\n'
    for cut in (4, 8, 10):
        unit = np.frombuffer(text[:cut], np.uint8)
        opened, closed, inside = splits.walk(unit, ord(","), False, 10)
        assert inside == (cut == 4)
        assert len(splits.row_ends(unit, opened, closed)) == {4: 0, 8: 1, 10: 2}[cut]


def test_only_crossing_rows_are_shuffled(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b"1,2\n" * 500)
    plain = splits.read_split_grid(spark, str(path), "*", 100)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    assert plain.count() == 500
