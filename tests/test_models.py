"""Brute-force models: the Spark operators against plain Python versions of
the catalogue's per-save dictionary updates, on random small inputs."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeledger.operators.edits import apply_edits, overlay
from lakeledger.operators.reconcile import upsert

FIELDS = ["description", "business_owner", "tags"]
T0 = dt.datetime(2024, 1, 1)

edit = st.tuples(st.sampled_from(["a", "b", "c", "zz"]), st.sampled_from(FIELDS),
                 st.one_of(st.none(), st.just(""), st.sampled_from(["x", "y", "z"])),
                 st.integers(0, 5))


def _schema():
    return "table_name string, description string, business_owner string, tags string, updated_at string"


def _model_overlay(rows, edits, drop_empty):
    """Saves applied in (edited_at, seq) order: kept values overwrite, every
    save stamps updated_at; only existing rows are shown changed."""
    ov = {}
    for seq, (t, f, v, minute) in sorted(enumerate(edits), key=lambda e: (e[1][3], e[0])):
        entry = ov.setdefault(t, {})
        keep = (v not in (None, "")) if drop_empty else (v is not None)
        if keep:
            entry[f] = v
        entry["updated_at"] = (T0 + dt.timedelta(minutes=minute)).isoformat()
    out = []
    for r in rows:
        r = dict(r)
        for k, v in ov.get(r["table_name"], {}).items():
            r[k] = v
        out.append(tuple(r[c] for c in ["table_name", *FIELDS, "updated_at"]))
    return sorted(out, key=str)


def _log(spark, edits):
    return spark.createDataFrame(
        [(t, f, v, T0 + dt.timedelta(minutes=m), i) for i, (t, f, v, m) in enumerate(edits)],
        "table_name string, field string, value string, edited_at timestamp_ntz, seq long")


BASE = [{"table_name": "a", "description": "d0", "business_owner": None, "tags": "t0", "updated_at": None},
        {"table_name": "b", "description": None, "business_owner": "o0", "tags": None, "updated_at": "u"},
        {"table_name": "c", "description": "", "business_owner": None, "tags": None, "updated_at": None}]


@settings(max_examples=12, deadline=None)
@given(st.lists(edit, max_size=12), st.booleans())
def test_overlay_matches_the_save_by_save_model(spark, edits, drop_empty):
    df = spark.createDataFrame([tuple(r.values()) for r in BASE], _schema())
    got = sorted((tuple(r) for r in overlay(df, _log(spark, edits), ["table_name"],
                                            drop="falsy" if drop_empty else "null").collect()), key=str)
    assert got == _model_overlay(BASE, edits, drop_empty)


@settings(max_examples=12, deadline=None)
@given(st.lists(edit, max_size=12))
def test_apply_matches_model_fields_and_stamps_now(spark, edits):
    df = spark.createDataFrame([tuple(r.values()) for r in BASE], _schema())
    got = {r.table_name: tuple(r) for r in apply_edits(df, _log(spark, edits), ["table_name"], "NOW").collect()}
    model = {r[0]: r for r in _model_overlay(BASE, edits, True)}
    kept = {t for t, f, v, m in edits if v not in (None, "")}
    for t, row in got.items():
        want = model[t]
        assert row[:4] == want[:4]  # fields as the overlay shows them (Q1: unedited fields kept)
        assert row[4] == ("NOW" if t in kept else dict((r["table_name"], r["updated_at"]) for r in BASE)[t])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.one_of(st.none(), st.text("xy", max_size=2))),
                max_size=4, unique_by=lambda r: r[0]),
       st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.one_of(st.none(), st.text("xy", max_size=2))),
                max_size=4, unique_by=lambda r: r[0]))
def test_upsert_matches_dict_merge(spark, target, source):
    schema = "table_name string, v string"
    got = sorted(tuple(r) for r in upsert(spark.createDataFrame(target, schema),
                                          spark.createDataFrame(source, schema), ["table_name"]).collect())
    model = dict(target)
    model.update(dict(source))
    assert got == sorted(model.items())
