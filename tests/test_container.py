"""Members of zip containers are read through Spark's storage, as streams."""

import io
import tracemalloc
import zipfile

import pytest

from chronotaxa.sources import container


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16"])
@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_pieces_are_whole_lines(encoding, size):
    for text in ("", "a", "a\n", "é\n\nbb\r\nc", "x" * 50 + "\ny"):
        pieces = list(container.whole_lines(io.BytesIO(text.encode(encoding)), encoding, size))
        assert "\n".join(p.decode() for p in pieces) == text.removesuffix("\n") and (pieces or not text)


def test_member_lines_and_seeking(spark, tmp_path):
    path = tmp_path / "a.zip"
    lines = [f"{k},é{k}" for k in range(5000)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("in/a.txt", "\n".join(lines) + "\n")
        zf.writestr("b.txt", "small")
    with container.opened(spark, str(path)) as zf:
        assert zf.namelist() == ["in/a.txt", "b.txt"] and zf.read("b.txt") == b"small"
    rows = container.member_lines(spark, str(path), "in/a.txt", size=1000).orderBy("block").collect()
    assert len(rows) > 20 and b"\n".join(bytes(r.raw) for r in rows).decode().split("\n") == lines
    (tmp_path / "no.zip").write_text("text")
    assert container.opened(spark, str(tmp_path / "no.zip")) is None


def test_memory_of_a_large_member():
    """A member of 200 MB is inflated in pieces."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as zf, zf.open("a", "w") as f:
        for _ in range(200):
            f.write(b"some line of text\n" * 58_000)
    tracemalloc.start()
    with zipfile.ZipFile(held) as zf, zf.open("a") as stream:
        total = sum(len(p) + 1 for p in container.whole_lines(stream, "utf-8", 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 200 * 18 * 58_000 and peak < 20 << 20
