"""Pairs of crowded lines are not made where the lines go on to be compared again."""

from collections import defaultdict
from itertools import combinations

from rankloom.llm import line_dedup


def test_two_crowded_lines_are_no_pair(spark):
    # Half of the line is the same in all, so one segment is crowded; the other half has few values, so others are not.
    lines = [f"the same first part of a line {i // 4:04d} and another {i % 4} end" for i in range(80)]
    ids, keys, own = line_dedup._keys_of(lines, 2)
    rows = line_dedup.checkpoint(spark.createDataFrame(list(zip(ids.tolist(), keys.tolist(), own.tolist())), "line_id long, key long, own boolean"))
    pairs, crowded = line_dedup._paired(rows, 16)
    many = {r[0] for r in crowded.collect()}
    assert len(many) > 16
    assert not [p for p in pairs.collect() if p["a"] in many and p["b"] in many]

    links = defaultdict(int)
    for r in line_dedup.line_links(spark.createDataFrame([("\n".join(lines),)], "text string"), crowd=16).collect():
        links[r["line_id"]] += r["links"]
    expected = defaultdict(int)
    for a, b in combinations(lines, 2):
        if line_dedup.edit_distance_within(a, b, 2) is not None:
            for x in (a, b):
                expected[int(line_dedup._signed([line_dedup._line_id(x)])[0])] += 1
    assert links == expected
