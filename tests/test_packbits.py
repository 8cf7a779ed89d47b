"""Packets of lines against a walk from byte to byte, and back."""

import random

from gridspark.plans import packbits

SCHEMA = "image_id bigint, y bigint, x bigint, v int"
KEYS = ["image_id", "y"]


def walked(line):
    out, literal, i = bytearray(), [], 0

    def flush():
        for k in range(0, len(literal), 128):
            out.extend([len(literal[k : k + 128]) - 1, *literal[k : k + 128]])
        literal.clear()

    while i < len(line):
        j = i
        while j < len(line) and line[j] == line[i]:
            j += 1
        if j - i < 3:
            literal.extend(line[i:j])
        else:
            flush()
            for k in range(i, j, 128):
                out.extend([(1 - min(128, j - k)) % 256, line[i]])
        i = j
    flush()
    return bytes(out)


def test_packets_equal_the_walk_and_decode_to_the_line(spark):
    rng = random.Random(3)
    lines = {(i, y): [b for _ in range(rng.randint(1, 60)) for b in [rng.choice([0, 1, 128, 255])] * rng.choice([1, 1, 1, 2, 3, 4])] for i in range(2) for y in range(20)}
    for y, n in enumerate((1, 2, 3, 127, 128, 129, 130, 131, 256, 257, 600)):
        lines[2, y] = [7] * n
        lines[3, y] = [k % 5 for k in range(n)]
        lines[4, y] = [9, 8] + [7] * n + [6] + [5, 5] * (n // 2)
    rows = [(*k, x * 3 - 5, v) for k, line in lines.items() for x, v in enumerate(line)]
    rng.shuffle(rows)
    packed = packbits.encode(spark.createDataFrame(rows, SCHEMA), KEYS, "x", "v").cache()
    got = {(r.image_id, r.y): r for r in packed.collect()}
    assert got.keys() == lines.keys()
    for k, line in lines.items():
        assert (got[k].n_bytes, bytes(got[k].packed)) == (len(line), walked(line)), k
    back = {(r.image_id, r.y): list(r.data) for r in packbits.decode(packed, KEYS).collect()}
    assert back == lines


def test_odd_rows_and_streams(spark):
    assert packbits.encode(spark.createDataFrame([], SCHEMA), KEYS, "x", "v").count() == 0
    rows = [(None, None, None, None), (None, None, 1, 300), (None, None, 1, -4), (None, None, 1, -4)]
    one = packbits.encode(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS byte"), KEYS, "x", "v").collect()
    assert [(r.n_bytes, bytes(r.packed)) for r in one] == [(4, bytes([254, 0, 0, 255]))]
    # a filler, a run of two and a literal; a literal and a run that end early
    odd = spark.createDataFrame([(1, bytearray(b"\x80\xff\x05\x80\x01ab")), (2, bytearray(b"\x02ab")), (3, bytearray(b"\xfe")), (4, None), (5, bytearray())], "image_id bigint, packed binary")
    assert {r.image_id: r.data and bytes(r.data) for r in packbits.decode(odd, ["image_id"]).collect()} == {1: b"\x05\x05ab", 2: None, 3: None, 4: None, 5: b""}
