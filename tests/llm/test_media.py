import hashlib
import zlib

import numpy as np
import pytest

from marketladder.llm import media
from tests.llm.helpers import table

ROWS = [(1, "Some text, é"), (1, "Some text, é"), (2, ""), (3, None), (None, "no id"), (4, "w" * 100_000), (5, "x" * 192)]


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.store_documents(table(spark, ROWS), path)
    got = media.read_features(spark, path).collect()
    want = []
    for doc, text in ROWS:
        data = (text or "").encode()
        payload = media.padded(data)
        assert len(payload) % 192 == 0 and len(payload) >= max(192, len(data)) and payload.startswith(data)
        image = media.to_image(payload)
        assert media.samples(image).tobytes() == payload
        want.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), media.describe(media.samples(image))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    media.store_documents(table(spark, []), f"file://{tmp_path}/none")
    assert media.read_features(spark, f"file://{tmp_path}/none").count() == 0


def test_ranges_cover_every_member_once(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    rows = [(i, f"text {i} " * (i % 50)) for i in range(300)]
    media.store_documents(table(spark, rows), path)
    reader = media.ArchiveReader(path, 1000, 4096, 3)
    parts = reader.partitions()
    assert len(parts) > 10
    names = [n for p in parts for batch in reader.read(p) for n in batch.column(0).to_pylist()]
    assert sorted(n.split("/")[0] for n in names) == sorted(str(i) for i in range(300))


def test_unlisted_files_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.store_documents(table(spark, ROWS), path)
    (tmp_path / "archives" / "part-000000-lost.zip").write_bytes(b"half an archive")
    assert media.read_features(spark, path).count() == len(ROWS)


def test_one_member_is_tried_again(tmp_path, spark):
    path = f"file://{tmp_path}/archives"
    media.store_documents(table(spark, ROWS), path)
    calls = []

    class Flaky:
        """A store whose second to fourth opened files break off."""

        def __init__(self, store):
            self.store = store

        def open_input_file(self, place):
            calls.append(place)
            if len(calls) in (2, 3):
                raise OSError("lost connection")
            return self.store.open_input_file(place)

    reader = media.ArchiveReader(path, 1 << 20, 1 << 20, 3)
    part = next(p for p in reader.partitions() if p.archive)
    store, folder = media._open(path)
    with store.open_input_file(f"{folder}/{part.archive}") as source, media.zipfile.ZipFile(source) as archive:
        members = archive.infolist()
    flaky = Flaky(store)
    bodies = [reader.member(flaky, f"{folder}/{part.archive}", m) for m in members]
    assert all(media.samples(b).size for b in bodies)
    assert len(calls) == len(members) + 2 or len(members) == 1
    calls[:] = [0]
    with pytest.raises(OSError):
        media.ArchiveReader(path, 1 << 20, 1 << 20, 2).member(flaky, f"{folder}/{part.archive}", members[0])


@pytest.mark.parametrize("short", [1, 2])
def test_a_read_cut_short_is_tried_again(tmp_path, spark, short):
    """The read of the lengths, or of the body, gives fewer bytes than asked for."""
    path = f"file://{tmp_path}/archives"
    media.store_documents(table(spark, ROWS), path)
    reads = []

    class Cut:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.file.close()

        def read_at(self, size, place):
            reads.append(size)
            return self.file.read_at(size, place)[: size // 2 if len(reads) == short else size]

    class Store:
        def open_input_file(self, place):
            return Cut(store.open_input_file(place))

    store, folder = media._open(path)
    reader = media.ArchiveReader(path, 1 << 20, 1 << 20, 2)
    place = f"{folder}/{next(p for p in reader.partitions() if p.archive).archive}"
    with store.open_input_file(place) as source, media.zipfile.ZipFile(source) as archive:
        member, body = archive.infolist()[0], archive.read(archive.infolist()[0])
    assert reader.member(Store(), place, member) == body
    assert len(reads) == short + 2
    reads.clear()
    with pytest.raises(OSError):
        media.ArchiveReader(path, 1 << 20, 1 << 20, 1).member(Store(), place, member)


def test_damage_is_noticed():
    image = bytearray(media.to_image(media.padded(b"abc")))
    image[50] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.samples(bytes(image))


def test_equal_samples_have_equal_features():
    pixels = np.arange(384, dtype=np.uint8).reshape(2, 192)
    assert media.describe(pixels) == media.describe(pixels.copy()) != media.describe(pixels // 2)
