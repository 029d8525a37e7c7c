"""Every line of a file is a row or a reject, with its number and reason."""

from fusemill.sources import rejects


def test_rows_and_rejects_are_all_lines(spark, tmp_path):
    good = '{"id": 1, "name": "a", "x": 1.5, "more": [1]}'
    first = [good, "", '{"id": 2', "[1]", '"text"', "null", '{"id": null, "name": "b"}', '{"name": "b"}', '{"id": 3, "name": "c"}', '{"id": "x", "name": "c"}', '{"id": 4, "name": "d", "x": "wide"}', '{"id": 5, "name": "e", "x": null}', "  "]
    (tmp_path / "a.jsonl").write_text("\n".join(first) + "\n")
    (tmp_path / "b.jsonl").write_text(good.replace("\n", "") + "\r\n\r\nno json")
    (tmp_path / "c.jsonl").write_text("")
    rows, bad = rejects.read(spark, str(tmp_path), "id bigint, name string, x double", ["id", "name"])
    kept = sorted((r.file[-7:], r.line, r.id, r.name, r.x) for r in rows.collect())
    assert kept == [("a.jsonl", 1, 1, "a", 1.5), ("a.jsonl", 9, 3, "c", None), ("a.jsonl", 12, 5, "e", None), ("b.jsonl", 1, 1, "a", 1.5)]
    out = sorted((r.file[-7:], r.line, r.reason) for r in bad.collect())
    assert out == [
        ("a.jsonl", 2, "blank"), ("a.jsonl", 3, "not_json"), ("a.jsonl", 4, "not_object"), ("a.jsonl", 5, "not_object"), ("a.jsonl", 6, "not_object"), ("a.jsonl", 7, "missing:id"), ("a.jsonl", 8, "missing:id"),
        ("a.jsonl", 10, "type:id"), ("a.jsonl", 11, "type:x"), ("a.jsonl", 13, "blank"), ("b.jsonl", 2, "blank"), ("b.jsonl", 3, "not_json"),
    ]
    assert len(kept) + len(out) == rejects.lines(spark, str(tmp_path)).count() == 16
