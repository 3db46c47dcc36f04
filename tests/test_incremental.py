"""Loads of a growing folder."""

import os

from sheetforge.sources import tables


def write(folder, names, content=b"x"):
    for n in names:
        path = folder / n
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content + n.encode())


def load(spark, folder, seen):
    drawings, rejected, fresh = tables.read_new_drawing_files(spark, str(folder), seen)
    rows = {os.path.basename(r["path"]): (r["drawing_id"], bytes(r["original_drawing"])) for r in drawings.collect()}
    bad = sorted(os.path.basename(r["path"]) for r in rejected.collect())
    tables.mark_seen(fresh, seen)
    return rows, bad


def test_two_loads_of_a_growing_folder_equal_one(spark, tmp_path):
    folder, seen = tmp_path / "in", f"file://{tmp_path}/seen"
    first, second = ["a.png", "b.pdf", "c/d.jpg", "e.txt"], ["f.png", "g/h.pdf", "i.doc"]
    write(folder, first)
    one, bad_one = load(spark, folder, seen)
    assert sorted(one) == ["a.png", "b.pdf", "d.jpg"] and bad_one == ["e.txt"]
    assert load(spark, folder, seen) == ({}, [])  # nothing new
    write(folder, second)
    two, bad_two = load(spark, folder, seen)
    assert sorted(two) == ["f.png", "h.pdf"] and bad_two == ["i.doc"]
    whole, bad = load(spark, folder, f"file://{tmp_path}/other")
    assert {n: c for n, (_, c) in whole.items()} == {n: c for n, (_, c) in (one | two).items()} and bad == sorted(bad_one + bad_two)
    ids = [i for i, _ in (one | two).values()]
    assert len(set(ids)) == len(ids) and min(i for i, _ in two.values()) > max(i for i, _ in one.values())


def test_a_changed_file_keeps_its_id_and_an_unmarked_load_comes_again(spark, tmp_path):
    folder, seen = tmp_path / "in", f"file://{tmp_path}/seen"
    write(folder, ["a.png", "b.png"])
    before, _, _ = tables.read_new_drawing_files(spark, str(folder), seen)
    assert before.count() == 2  # not marked: found again
    one, _ = load(spark, folder, seen)
    write(folder, ["b.png"], b"longer ")
    two, _ = load(spark, folder, seen)
    assert list(two) == ["b.png"] and two["b.png"][0] == one["b.png"][0] and two["b.png"][1] == b"longer b.png"
    assert load(spark, folder, seen) == ({}, [])
