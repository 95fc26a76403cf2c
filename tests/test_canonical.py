"""Pinned digests and scalar rules."""

import pytest
from pyspark.sql import functions as F

from feedproj.functions import cursor, ids, text, times
from feedproj.operators import canonical as C

AS_OF = "2024-06-01 00:00:00"

# Pinned digests of the checksum contract.
POST_ONE = "bb16c1752b439914af06305934cffd96308c7e25803f241e8b8991af4969de96"
POST_TWO = "96de8d8059ea8f5d0c0808d5a5f973fecca145722c75110a92f6f36b6ceeeb88"
PAGE_ONE = "13621b9d94428d024d108405bd5992438e8c174c2b7d5667269d2c6cc81f1307"
PAGE_TWO = "dc020024d310f586655d5d387a5b6f7ead3c0c69c930017cefb6c34a9184243f"
CATEGORY_ONE = "b5845d198f701098ea1bf28d2b1c02013d6f30f328cc73f63f28e76b07249811"


def raw_post(spark, cats, meta, **changes):
    row = {
        "ID": "7", "post_type": "post", "post_name": "my-post", "post_status": "publish",
        "post_title": " My Post\x0b\n", "post_content": "<p>Content</p>", "post_excerpt": "Excerpt",
        "post_date_gmt": "2024-03-01 09:00:00", "post_modified_gmt": "2024-03-02 10:00:00",
        "post_author": "1", "post_author_login": "editor", "category_ids": cats, "meta": meta,
    }
    row.update(changes)
    ddl = ", ".join(f"{k} string" for k in row if k not in ("category_ids", "meta"))
    return spark.createDataFrame([row], ddl + ", category_ids array<bigint>, meta map<string,string>")


def digest(df, spec):
    return C.canonical_rows(df, spec, AS_OF).first()["checksum"]


@pytest.mark.parametrize(
    "cats,meta,want",
    [
        ([3, 5], {"key": "val"}, POST_ONE),
        ([3, 5], {"b": "2", "a": "1"}, POST_TWO),
        ([5, 3], {"a": "1", "b": "2"}, POST_TWO),
    ],
)
def test_post_digest(spark, cats, meta, want):
    assert digest(raw_post(spark, cats, meta), C.POST) == want


def raw_page(spark, parent, order, meta, title="Contact"):
    row = ("5", "page", "contact", "publish", title, "<p>Contact page</p>", "2024-01-01 08:00:00",
           "2024-01-02 08:00:00", parent, order, meta)
    return spark.createDataFrame(
        [row],
        "ID string, post_type string, post_name string, post_status string, post_title string,"
        "post_content string, post_date_gmt string, post_modified_gmt string, post_parent string,"
        "menu_order string, meta map<string,string>",
    )


def test_page_digests(spark):
    assert digest(raw_page(spark, "3", "2", {"_seo": "contact"}), C.PAGE) == PAGE_ONE
    for meta in ({"z": "last", "a": "first"}, {"a": "first", "z": "last"}):
        assert digest(raw_page(spark, "3", "2", meta), C.PAGE) == PAGE_TWO


def test_category_digest(spark):
    row = spark.createDataFrame(
        [("3", "PHP", "php", "PHP programming", "7", "5", "category")],
        "term_id string, name string, slug string, description string, parent string, count string,"
        "taxonomy string",
    )
    assert digest(row, C.CATEGORY) == CATEGORY_ONE


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,want",
    [
        (None, "[]"),
        ({}, "[]"),
        ({"b": "x/y", "a": "é"}, '{"a":"é","b":"x\\/y"}'),
        ({"a": "\x0b\x1f\n\"\\"}, '{"a":"\\u000b\\u001f\\n\\"\\\\"}'),
        ({"a": "\\u000B"}, '{"a":"\\\\u000B"}'),
        ({"a": "\u2028"}, '{"a":"\\u2028"}'),
    ],
)
def test_canonical_json(spark, value, want):
    assert one(spark, value, text.canonical_map_json, "map<string,string>") == want


def test_canonical_ids(spark):
    assert one(spark, [5, 3], text.canonical_ids_json, "array<bigint>") == "[3,5]"
    assert one(spark, [], text.canonical_ids_json, "array<bigint>") == "[]"


@pytest.mark.parametrize(
    "changes,want",
    [
        ({}, []),
        ({"ID": "0"}, ["number:ID"]),
        ({"ID": "x", "post_name": " \t"}, ["number:ID", "text:post_name"]),
        ({"post_type": "page", "post_date_gmt": "nonsense"}, ["kind:post_type"]),
        ({"post_date_gmt": "nonsense"}, ["date:post_date_gmt"]),
        ({"post_modified_gmt": "2024-01-01T00:00:00+02:00"}, []),
        ({"post_modified_gmt": "2024-02-31 00:00:00"}, ["date:post_modified_gmt"]),
        ({"post_modified_gmt": "2024-01-01T00:00:00-02:00"}, ["date:post_modified_gmt"]),
        ({"post_date_gmt": "0000-00-00 00:00:00", "post_modified_gmt": None}, []),
        ({"post_status": None}, ["text:post_status"]),
    ],
)
def test_violations(spark, changes, want):
    row = raw_post(spark, [], {}, **changes).select(C.violations(C.POST).alias("v")).first()
    assert row["v"] == want


def test_extract_defaults(spark):
    df = raw_post(spark, None, None, post_author_login=None, post_title=None,
                  post_date_gmt="0000-00-00 00:00:00")
    row = C.extract(df, C.POST, AS_OF).first()
    assert (row.author, row.title, row.category_ids, row.meta) == ("1", "", [], {})
    assert str(row.published_at) == AS_OF


@pytest.mark.parametrize(
    "value,want",
    [
        ("2024-01-01 10:00:00", "2024-01-01 10:00:00"),
        ("2024-01-01T10:00:00Z", "2024-01-01 10:00:00"),
        ("2024-01-01T10:00:00+02:00", "2024-01-01 08:00:00"),
        ("", AS_OF),
        ("tomorrow", None),
    ],
)
def test_parse_gmt(spark, value, want):
    got = one(spark, value, lambda c: times.parse_gmt(c, AS_OF).cast("string"))
    assert got == want


def test_iso_utc(spark):
    assert one(spark, "2024-01-01 10:00:00", times.iso_utc) == "2024-01-01T10:00:00+00:00"
    assert one(spark, "never", times.iso_utc) is None


def test_first_values(spark):
    got = one(spark, {"a": ["1", "2"], "b": []}, text.first_values, "map<string,array<string>>")
    assert got == {"a": "1", "b": ""}
    assert one(spark, ["4", "x"], text.id_list, "array<string>") == [4, 0]


def test_time_ordered_id(spark):
    row = spark.createDataFrame([("2024-01-01 00:00:00.123", "k")], "t string, k string").select(
        ids.time_ordered_id(F.col("t").cast("timestamp"), F.col("k")).alias("i")
    ).first()["i"]
    assert len(row) == 36 and row[14] == "7" and row[19] in "89ab"
    assert int(row.replace("-", "")[:12], 16) == 1704067200123


@pytest.mark.parametrize(
    "value,want",
    [
        (None, '{"raw":"null"}'),
        ("not json", '{"raw":"not json"}'),
        ('{"a":1}', '{"a":1}'),
        ("[1,2]", "[1,2]"),
    ],
)
def test_snapshot(spark, value, want):
    assert one(spark, value, text.coerce_snapshot) == want


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "ab" * 40)], "s string, id string")
    token = df.select(cursor.encode_cursor(F.col("s"), F.col("id")).alias("c"))
    text_token = token.first()["c"]
    assert not set(text_token) & set("+/=\n\r")
    back = token.select(cursor.decode_cursor(F.col("c")).alias("d")).first()["d"]
    assert (back.s, back.id) == ("2024-01-01 00:00:00", "ab" * 40)
    for bad in ("!!!", "e30", "bm90anNvbg"):
        assert one(spark, bad, cursor.decode_cursor) is None


def test_decode_meta_and_slug(spark):
    assert one(spark, '{"a":"1"}', text.decode_meta) == {"a": "1"}
    assert one(spark, "[]", text.decode_meta) == {}
    assert one(spark, "broken", text.decode_meta) == {}
    assert one(spark, "a-b_1", text.slug_pattern) is True
    assert one(spark, "A b", text.slug_pattern) is False
