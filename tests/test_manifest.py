"""Manifests: shapes that count, shapes that do not, and finding the right version."""

import json

import pytest
from pyspark.sql import functions as F

from freshet.functions.expressions import base_version
from freshet.sources.manifest import ManifestSpec, manifest_from_text, resolve_manifest


def rows(spark, doc):
    return [
        (r.schema, r.table, r.column, r.kind, tuple(r.range) if r.range else None)
        for r in manifest_from_text(spark, json.dumps(doc)).orderBy("seq").collect()
    ]


def source(**more):
    return {"sources": {"x": {"schema": "public", "name": "t", **more}}}


def column(mask, via="config"):
    node = {"meta": {"masking": mask}}
    return {"columns": {"c": {"config": node} if via == "config" else node}}


@pytest.mark.parametrize("doc, expected", [
    (source(**column("email")), [("public", "t", "c", "email", None)]),
    (source(**column({"kind": "float", "range": "15-75"})), [("public", "t", "c", "float", (15.0, 75.0))]),
    (source(**column({"kind": "float", "range": "0.25-0.75"}, "meta")), [("public", "t", "c", "float", (0.25, 0.75))]),
    (source(**column({"kind": "float", "range": "junk"})), [("public", "t", "c", "float", None)]),
    (source(**column({"kind": "float", "range": [1, 2]})), [("public", "t", "c", "float", None)]),
    (source(**column({"range": "1-2"})), []),
    (source(**column(["email"])), []),
    (source(**column(None)), []),
    (source(**column("sparkle")), [("public", "t", "c", "sparkle", None)]),
    (source(config={"meta": {"masking": "truncate"}}, columns={}), [("public", "t", None, "truncate", None)]),
    (source(meta={"masking": {"kind": "truncate"}}), [("public", "t", None, "truncate", None)]),
    (source(config={"meta": {"masking": None}}, meta={"masking": "truncate"}), []),
    (source(schema=7, **column("email")), []),
    ({"sources": {"a": {"name": "t", **column("email")}, "b": {"schema": "s", **column("email")}}}, []),
    ({"sources": [source()]}, []),
    ({"nodes": {}}, []),
    (source(columns={"a.b": {"meta": {"masking": "name"}}, "q'": {"meta": {"masking": "url"}}}),
     [("public", "t", "a.b", "name", None), ("public", "t", "q'", "url", None)]),
])
def test_flattening(spark, doc, expected):
    assert rows(spark, doc) == expected


def test_bad_json_fails(spark):
    with pytest.raises(Exception):
        manifest_from_text(spark, "{oops").collect()


@pytest.mark.parametrize("version, base", [
    ("5.17.3", "5.17.0"), ("5.17.0", None), ("5.17", None), ("words", None), ("5.x.3", None),
    ("5.017.3", "5.17.0"), ("v2.1.3", "v2.1.0"), ("1.2.3.4", None), ("2.4294967296.1", None), ("2.1.99999999999", None),
])
def test_base_version(spark, version, base):
    assert spark.range(1).select(base_version(F.lit(version))).first()[0] == base


@pytest.mark.parametrize("spec, fine", [
    (ManifestSpec("/m.json"), True),
    (ManifestSpec("/m-{version}.json", version="1.0.0"), True),
    (ManifestSpec("/m-{version}.json", version_query="select 1"), True),
    (ManifestSpec("/m-{version}.json"), False),
    (ManifestSpec("/m.json", version="1.0.0"), False),
    (ManifestSpec("/m-{version}.json", version="1", version_query="select 1"), False),
])
def test_spec_check(spec, fine):
    if fine:
        spec.check()
    else:
        with pytest.raises(ValueError):
            spec.check()


def test_versions_resolve_with_a_fallback(spark, tmp_path):
    (tmp_path / "m-5.17.0.json").write_text(json.dumps(source(**column("email"))))
    path = f"{tmp_path}/m-{{version}}.json"
    query = "SELECT v FROM VALUES ('5.17.3') AS t(v)"
    version, found = resolve_manifest(spark, ManifestSpec(path, version_query=query, fallback_to_base=True))
    assert version == "5.17.3" and found.count() == 1
    with pytest.raises(Exception):
        resolve_manifest(spark, ManifestSpec(path, version="5.17.3"))[1].collect()
    with pytest.raises(LookupError):
        resolve_manifest(spark, ManifestSpec(path, version_query="SELECT 1 WHERE false"))
