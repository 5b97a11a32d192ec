"""Scene files: written part by part and read by ranges, against the encoder and decoder of whole files."""

import json

import numpy as np
import pytest

from contiguum.operators.scene import Scene, bounding_box
from contiguum.sources import scene_file as sf

ODD = [",", "", '"', '","', "\\", '\\"', "a\\", "é ", "\U0001f600", "]", '],"bbox":[', '"idTable":[', "x" * 300, "\\" * 200, "\n\t", "s1", "s1"]


def made(spark, n, links, ids=None, parts=5):
    rng = np.random.default_rng(n + links)
    ids = [ids[k % len(ids)] for k in range(n)] if ids else [f"s{k}" for k in range(n)]
    pos, wide, color = rng.normal(size=(n, 4)).astype("f4"), rng.random((n, 1)).astype("f4"), rng.integers(0, 256, (n, 4))
    at, ends = rng.normal(size=(links, 4)).astype("f4"), np.stack([rng.integers(0, max(n, 1), links), rng.integers(0, 2, links)] * 2, 1) if links else np.zeros((0, 4), int)
    c = spark.createDataFrame([(3 * k + 1, ids[k], *map(float, pos[k]), float(wide[k, 0]), *map(int, color[k])) for k in range(n)], sf.CONTIGS.removeprefix("path string, ")).repartition(parts)
    m = spark.createDataFrame([(2 * k, *map(float, at[k]), *map(int, ends[k])) for k in range(links)], sf.LINKS.removeprefix("path string, ")).repartition(parts)
    box = bounding_box(spark.createDataFrame([(0.5, -1.25), (3.0, 7.0)], "x double, y double"))
    tables = {"contigPositions": pos, "contigWidth": wide, "contigColor": color, "linkPositions": at, "linkEndpoints": ends}
    return Scene("a \"source\"", c, m, box), sf.encode("a \"source\"", ids, (0.5, -1.25, 3.0, 7.0), tables)


@pytest.mark.parametrize(("n", "links", "ids"), [(0, 0, None), (1, 0, ODD[:1]), (len(ODD), 3, ODD), (700, 900, None), (331, 40, ODD)])
def test_written_bytes_are_the_encoders(spark, tmp_path, n, links, ids, monkeypatch):
    scene, want = made(spark, n, links, ids)
    told = sf.write_gsc1(scene, f"file://{tmp_path}/a b.gsc")
    blob = (tmp_path / "a b.gsc").read_bytes()
    assert blob == want and told == {"bytes": len(want), "contigs": n, "links": links}
    assert [p.name for p in tmp_path.iterdir()] == ["a b.gsc"]
    assert sf.scene_bytes(scene) == want
    # a store that only appends
    sf._append(spark.createDataFrame([(k, want[k : k + 100]) for k in range(0, len(want), 100)], "at long, data binary").repartition(3), f"file://{tmp_path}/again.gsc")
    assert (tmp_path / "again.gsc").read_bytes() == want
    whole = sf.decode(want)
    for size in (1 << 22, 7):  # ranges far smaller than an id as well
        monkeypatch.setattr(sf, "RANGE", size)
        monkeypatch.setattr(sf, "ROWS", 1 << 16 if size > 7 else 11)
        if size == 7 and n > 400:
            monkeypatch.setattr(sf, "RANGE", 101)
        got = sf.read_contigs(spark, f"file://{tmp_path}/a b.gsc").orderBy("ord").toPandas()
        assert got["id"].tolist() == whole["idTable"] and got["ord"].tolist() == list(range(n))
        assert np.array_equal(got[["in_x", "in_y", "out_x", "out_y"]].to_numpy("f4"), whole["contigPositions"]) and np.array_equal(got[["width"]].to_numpy("f4"), whole["contigWidth"])
        assert np.array_equal(got[list("rgba")].to_numpy("u1"), whole["contigColor"])
        back = sf.read_links(spark, f"file://{tmp_path}/a b.gsc").orderBy("ord").toPandas()
        assert np.array_equal(back[["x0", "y0", "x1", "y1"]].to_numpy("f4"), whole["linkPositions"]) and np.array_equal(back[["contig_a", "side_a", "contig_b", "side_b"]].to_numpy("u4"), whole["linkEndpoints"])
    head = sf.read_headers(spark, f"file://{tmp_path}/a b.gsc").first()
    assert (head.contigs, head.links, head.source, head.bbox) == (n, links, 'a "source"', [0.5, -1.25, 3.0, 7.0])


def test_many_files_and_old_ones(spark, tmp_path):
    """A folder of files; one without link endpoints reads as zeros; a wrong magic raises."""
    for k, n in enumerate((3, 5)):
        (tmp_path / f"{k}.gsc").write_bytes(made(spark, n, n)[1])
    blob = (tmp_path / "1.gsc").read_bytes()
    body = 8 + int.from_bytes(blob[4:8], "little")
    head = json.loads(blob[8:body])
    del head["columns"]["linkEndpoints"]
    text = json.dumps(head, separators=(",", ":")).encode()
    (tmp_path / "1.gsc").write_bytes(b"GSC1" + len(text).to_bytes(4, "little") + text + blob[body:])
    got = sf.read_contigs(spark, f"file://{tmp_path}/*.gsc").groupBy("path").count().orderBy("path").collect()
    assert [r["count"] for r in got] == [3, 5]
    links = sf.read_links(spark, f"file://{tmp_path}/1.gsc").toPandas()
    assert len(links) == 5 and not links[["contig_a", "side_b"]].to_numpy().any() and links.x0.abs().sum() > 0
    (tmp_path / "bad.gsc").write_bytes(b"XXXX" + bytes(8))
    with pytest.raises(Exception, match="bad magic"):
        sf.read_links(spark, f"file://{tmp_path}/bad.gsc").count()
