"""The GFA data source against the text reader."""

import io
import random

import pytest

from contiguum.sources import gfa, gfa_source

from conftest import TINY


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("seed", range(4))
def test_every_line_is_in_one_range(seed):
    rnd = random.Random(seed)
    blob = b"".join(bytes(rnd.choices(b"ab\t", k=rnd.randrange(9))) + b"\n" for _ in range(60)) + (b"" if seed % 2 else b"last")
    want, at = [], 0
    for line in blob.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    want = want if blob[-1:] != b"\n" else want[:-1]
    for split in (1, 2, 7, 50, 10_000):
        for chunk in (1, 3, 64):
            got = [x for a in range(0, len(blob), split) for x in gfa_source.lines_between(Bytes(blob), a, min(a + split, len(blob)), chunk)]
            assert got == want


def test_source_equals_the_text_reader(spark, tmp_path):
    odd = TINY.replace("S\ts4", "  # no row\n\n \tS\ts4".replace("\t", "", 1), 1) + "# end\r\nP\tp1\ts1+\t*\r\nW\tx\n" + "S\ts7\t" + "A" * 5000 + "\tXX:Z:é\udcff".encode("utf-8", "replace").decode() + "\r\n"
    (tmp_path / "t.gfa").write_bytes(odd.encode())
    path = f"file://{tmp_path}/t.gfa"
    want = gfa.read_gfa(spark, path)
    for split in (64 << 20, 37):
        got = gfa_source.read_gfa(spark, path, split=split)
        for table in ("segments", "links"):
            a, b = (sorted(map(str, getattr(g, table).collect())) for g in (got, want))
            assert a == b and a
        seg = gfa_source.read_segments(spark, path, split)
        assert sorted(map(str, seg.collect())) == sorted(map(str, want.segments.collect()))
    rows = gfa_source.lines(spark, path).groupBy("record").count().collect()
    assert {r.record: r["count"] for r in rows} == {r.record: r.n for r in gfa.record_counts(gfa.read_lines(spark, path)).collect()}


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.gfa").write_text(TINY.replace("s", name))
    (tmp_path / "c.txt").write_text(TINY)
    df = gfa_source.lines(spark, f"file://{tmp_path}").filter("record = 'S'")
    assert "Filter " not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 12 and gfa_source.lines(spark, f"file://{tmp_path}").filter("record IN ('L', 'H') AND record <> 'H'").count() == 8
    assert [r.id for r in gfa_source.read_segments(spark, f"file://{tmp_path}").orderBy("ord").collect()] == [f"{n}{k}" for n in "ab" for k in range(1, 7)]
    reader = gfa_source.GfaReader(f"{tmp_path}/a.gfa", 1 << 20)
    assert list(reader.pushFilters([gfa_source.EqualTo(("record",), "L"), gfa_source.EqualTo(("file",), "x")])) == [gfa_source.EqualTo(("file",), "x")]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4
    with pytest.raises(Exception, match="none"):
        gfa_source.lines(spark, f"file://{tmp_path}/none.gfa").count()
