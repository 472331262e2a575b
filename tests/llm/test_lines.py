"""Line kernels: only what the wanted lines have is hashed."""

import numpy as np

from panelworks.llm import line_dedup, piece_encoding, text_kernels


def test_shingles_of_a_line_do_not_depend_on_what_stands_around_it():
    line = "Ein Satz über die Größe der Dinge, überall gleich".encode()
    around = b"\x80\x80 other text of the chunk, malformed, in capitals and longer than the line itself\n" * 3
    keys = np.array([5], np.uint64)
    alone, _ = line_dedup.line_shingles(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line)]), keys, 8)
    within, begin = line_dedup.line_shingles(np.frombuffer(around + line, np.uint8), np.array([len(around)]), np.array([len(around) + len(line)]), keys, 8)
    assert begin.tolist() == [0] and np.array_equal(alone, within)
    assert len(alone) == len(line.decode()) - 7  # characters, not bytes


def test_shingles_of_all_lines_are_those_of_each():
    texts = ["a", "Häuser am See und überall sonst", "plain line of text that is long enough", "kurz", "x" * 9]
    data, at = text_kernels.utf8(line_dedup.pa.array(["\n".join(texts)]))
    starts, ends, _, keys, _ = line_dedup.solid_lines(data, at)
    flat, begin = line_dedup.line_shingles(data, starts, ends, keys, 8)
    parts = np.split(flat, begin[1:])
    for k in range(len(texts)):
        own, _ = line_dedup.line_shingles(data, starts[k : k + 1], ends[k : k + 1], keys[k : k + 1], 8)
        assert np.array_equal(parts[k], own)


def test_a_codec_goes_with_its_broadcast():
    class Shared:  # as a worker's broadcast
        value = ([("<unk>", 0.0, "u"), ("a", -1.0, "n")], 1)

    before, shared = len(piece_encoding._codecs), Shared()
    assert piece_encoding._codec(shared) is piece_encoding._codec(shared)
    assert len(piece_encoding._codecs) == before + 1
    del shared
    assert len(piece_encoding._codecs) == before


def test_lean_tasks_give_what_they_gave():
    batch = line_dedup.pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert list(text_kernels.lean(iter)([batch, batch])) == [batch, batch]
