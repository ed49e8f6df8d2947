"""One document per lockfile dialect, with the release and edge sets expected of it."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.session import Scratch
from faultline.sources import lockfiles as L
from faultline.sources import registry as G

NPM3 = {
    "name": "root", "lockfileVersion": 3,
    "packages": {
        "": {"name": "root", "dependencies": {"a": "^1.0.0", "ws": "*", "missing": "1"}, "devDependencies": {"d": "~2.0.0"}},
        "node_modules/a": {"version": "1.1.0", "resolved": "https://r/a", "integrity": "sha-a", "dependencies": {"b": "^1.0.0"}, "devDependencies": {"d": "1"}},
        "node_modules/b": {"version": "2.0.0"},
        "node_modules/a/node_modules/b": {"version": "1.5.0", "dependencies": {"alias": "1"}},
        "node_modules/alias": {"name": "real", "version": "9.0.0"},
        "node_modules/d": {"version": "2.0.3", "dev": True, "dependencies": {"@s/x": "1"}},
        "node_modules/@s/x": {"version": "1.0.0", "dev": True},
        "node_modules/ws": {"resolved": "packages/ws", "link": True},
        "packages/ws": {"name": "@me/ws", "version": "0.1.0", "devDependencies": {"b": "2"}},
    },
}
NPM1 = {
    "name": "r1", "lockfileVersion": 1, "requires": True,
    "dependencies": {
        "a": {"version": "1.1.0", "requires": {"b": "^1.0.0", "c": "1"}, "dependencies": {"b": {"version": "1.5.0", "requires": {"c": "^3"}}}},
        "b": {"version": "2.0.0"}, "c": {"version": "3.0.0", "dev": True},
        "f": {"version": "file:../f", "dependencies": {"g": {"version": "1.0.0"}}},
    },
}
MANIFEST = json.dumps({"name": "m", "dependencies": {"a": "^1.0.0", "zz": "1"}, "devDependencies": {"c": "3"}})
YARN = '''# yarn lockfile v1


"@s/x@^1.0.0", "@s/x@^1.2.0":
  version "1.2.3"
  resolved "https://r/x"
  integrity sha512-abc
  dependencies:
    b "^2.0.0"
    "@s/y" "~1.0"
  optionalDependencies:
    fsevents "^1"

b@^2.0.0:
  version "2.1.0"

"@s/y@~1.0":
  version "1.0.9"

d@npm:real@^3:
  version "3.0.0"
  dependencies:
    b "^2.0.0"
    e "*"

e:
  version "0.0.1"
'''
YARN_MANIFEST = json.dumps({"name": "ym", "dependencies": {"@s/x": "^1.2.0"}, "devDependencies": {"d": "npm:real@^3"}})
PNPM9 = """lockfileVersion: '9.0'

settings:
  autoInstallPeers: true

importers:

  .:
    dependencies:
      a:
        specifier: ^1.0.0
        version: 1.0.0(p@2.0.0)
    devDependencies:
      '@s/x':
        specifier: ~2.0.0
        version: 2.0.1
      lnk:
        specifier: workspace:*
        version: link:../lnk
  packages/w:
    dependencies:
      al:
        specifier: npm:real@1
        version: npm:real@1.2.3

packages:

  '@s/x@2.0.1':
    resolution: {integrity: sha512-x, tarball: https://t/x.tgz}
    engines: {node: '>=6'}

  a@1.0.0:
    resolution: {integrity: sha512-a}

  p@2.0.0:
    resolution: {integrity: sha512-p}

  real@1.2.3:
    resolution: {integrity: sha512-r}

snapshots:

  '@s/x@2.0.1':
    dependencies:
      p: 2.0.0

  a@1.0.0(p@2.0.0):
    dependencies:
      p: 2.0.0

  p@2.0.0: {}

  real@1.2.3: {}
"""
PNPM6 = """lockfileVersion: '6.0'

dependencies:
  a:
    specifier: ^1.0.0
    version: 1.0.0

devDependencies:
  z:
    specifier: '2'
    version: 2.0.0

packages:

  /a@1.0.0:
    resolution: {integrity: sha512-a}
    dependencies:
      b: 1.0.1
    dev: false

  /b@1.0.1:
    resolution: {integrity: sha512-b}
    dev: false

  /z@2.0.0:
    resolution: {integrity: sha512-z}
    dependencies:
      b: 1.0.1
    dev: true
"""
DOCUMENTS = [
    ("n3", "n3/package-lock.json", json.dumps(NPM3), None), ("n1", "n1/package-lock.json", json.dumps(NPM1), MANIFEST),
    ("y", "y/yarn.lock", YARN, YARN_MANIFEST), ("y2", "y2/yarn.lock", YARN.replace("\n", "\r\n"), YARN_MANIFEST),
    ("p9", "p9/pnpm-lock.yaml", PNPM9, None), ("p6", "p6/pnpm-lock.yaml", PNPM6, None),
]
# (name, version, dev, direct)
RELEASES = {
    "n3": {("@me/ws", "0.1.0", False, True), ("@s/x", "1.0.0", True, False), ("a", "1.1.0", False, True), ("b", "1.5.0", False, False),
           ("b", "2.0.0", False, False), ("d", "2.0.3", True, True), ("real", "9.0.0", False, False)},
    "n1": {("a", "1.1.0", False, True), ("b", "1.5.0", False, False), ("b", "2.0.0", False, False), ("c", "3.0.0", True, True)},
    "y": {("@s/x", "1.2.3", False, True), ("@s/y", "1.0.9", False, False), ("b", "2.1.0", False, False), ("d", "3.0.0", True, True), ("e", "0.0.1", True, False)},
    "p9": {("@s/x", "2.0.1", True, True), ("a", "1.0.0", False, True), ("p", "2.0.0", False, False), ("real", "1.2.3", False, False)},
    "p6": {("a", "1.0.0", False, True), ("b", "1.0.1", False, False), ("z", "2.0.0", True, True)},
}
# (source, source version, target, constraint, target version, dev)
EDGES = {
    "n3": {(None, None, "@me/ws", "*", "0.1.0", False), (None, None, "a", "^1.0.0", "1.1.0", False), (None, None, "d", "~2.0.0", "2.0.3", True),
           ("@me/ws", "0.1.0", "b", "2", "2.0.0", True), ("a", "1.1.0", "b", "^1.0.0", "1.5.0", False), ("b", "1.5.0", "real", "1", "9.0.0", False),
           ("d", "2.0.3", "@s/x", "1", "1.0.0", True)},
    "n1": {(None, None, "a", "^1.0.0", "1.1.0", False), (None, None, "c", "3", "3.0.0", True), ("a", "1.1.0", "b", "^1.0.0", "1.5.0", False),
           ("a", "1.1.0", "c", "1", "3.0.0", False), ("b", "1.5.0", "c", "^3", "3.0.0", False)},
    "y": {(None, None, "@s/x", "^1.2.0", "1.2.3", False), (None, None, "d", "npm:real@^3", "3.0.0", True), ("@s/x", "1.2.3", "@s/y", "~1.0", "1.0.9", False),
          ("@s/x", "1.2.3", "b", "^2.0.0", "2.1.0", False), ("d", "3.0.0", "b", "^2.0.0", "2.1.0", True), ("d", "3.0.0", "e", "*", "0.0.1", True)},
    "p9": {(None, None, "@s/x", "~2.0.0", "2.0.1", True), (None, None, "a", "^1.0.0", "1.0.0", False), (None, None, "real", "npm:real@1", "1.2.3", False),
           ("@s/x", "2.0.1", "p", "2.0.0", "2.0.0", True), ("a", "1.0.0", "p", "2.0.0", "2.0.0", False)},
    "p6": {(None, None, "a", "^1.0.0", "1.0.0", False), (None, None, "z", "2", "2.0.0", True), ("a", "1.0.0", "b", "1.0.1", "1.0.1", False),
           ("z", "2.0.0", "b", "1.0.1", "1.0.1", True)},
}


@pytest.fixture(scope="module")
def parsed(spark):
    from faultline.session import Scratch

    docs = spark.createDataFrame(DOCUMENTS, "doc string, path string, text string, manifest string")
    found = L.parse_documents(docs, Scratch(spark, "lockfiles"))
    return found.releases.collect(), found.edges.collect()


@pytest.mark.parametrize("doc", ["n3", "n1", "y", "y2", "p9", "p6"])
def test_releases_and_edges(parsed, doc):
    releases, edges = parsed
    want = doc.rstrip("2") if doc == "y2" else doc
    got = [(r.name, r.version, r.dev, r.direct) for r in releases if r.doc == doc]
    assert set(got) == RELEASES[want] and len(got) == len(RELEASES[want])
    got = [(e.src_name, e.src_version, e.dst_name, e.constraint_, e.dst_version, e.dev) for e in edges if e.doc == doc]
    assert set(got) == EDGES[want] and len(got) == len(EDGES[want])


def test_urls_and_integrity(parsed):
    known = {(r.doc, r.name): (r.resolved_url, r.integrity) for r in parsed[0]}
    assert known[("n3", "a")] == ("https://r/a", "sha-a")
    assert known[("y", "@s/x")] == ("https://r/x", "sha512-abc")
    assert known[("p9", "@s/x")] == ("https://t/x.tgz", "sha512-x")


def test_files_are_discovered_with_their_manifest(spark, tmp_path):
    for path, text in {
        "yarn.lock": "a@1:\n  version \"1.0.0\"\n", "package.json": '{"name":"top"}', "web/package-lock.json": "{}", "web/package.json": '{"name":"web"}',
        "web/node_modules/x/yarn.lock": "no", ".cache/yarn.lock": "no", "docs/yarn.lock.bak": "no", "deep/er/pnpm-lock.yaml": "a: b",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    got = {r.path: r.manifest for r in L.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"yarn.lock": '{"name":"top"}', "web/package-lock.json": '{"name":"web"}', "deep/er/pnpm-lock.yaml": None}


def test_unreadable_documents_are_named(spark):
    rows = [("a", "a/package-lock.json", "<html>", None), ("b", "b/package-lock.json", "{\"packages\":{}}", None), ("c", "c/other.txt", "x", None),
            ("d", "d/pnpm-lock.yaml", "just text", None), ("e", "e/package-lock.json", "[1]", None), ("f", "f/package-lock.json", "{\"a\":", None)]
    df = spark.createDataFrame(rows, "doc string, path string, text string, manifest string")
    assert {r.doc for r in L.unreadable(df).collect()} == {"a", "c", "d", "e", "f"}


def test_addresses_and_times(spark):
    rows = [
        ("git@github.com:org/repo.git", "https://github.com/org/repo", "org/repo"), ("ssh://git@host/org/repo.git", "https://host/org/repo", "org/repo"),
        ("https://host/a/b/c.git", "https://host/a/b/c", "b/c"), ("git://host/org/repo.git", "https://host/org/repo", "org/repo"),
        ("http://host/one", "http://host/one", "one"), ("ftp://host/org/repo", None, "org/repo"), ("git@host", None, "git@host"),
    ]
    df = spark.createDataFrame(rows, "u string, a string, n string")
    got = df.select("u", G.https_address(F.col("u")).alias("a"), G.repository_name(F.col("u")).alias("n")).collect()
    assert {r.u: (r.a, r.n) for r in got} == {u: (a, n) for u, a, n in rows}
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.678Z",), ("2024-01-02T03:04:05+02:00",), ("yesterday",), (None,)], "t string")
    got = {r.t: r.s for r in times.select("t", G.iso_text(G.iso_time(F.col("t"))).alias("s")).collect()}
    assert got == {"2024-01-02T03:04:05Z": "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.678Z": "2024-01-02T03:04:05Z",
                   "2024-01-02T03:04:05+02:00": "2024-01-02T01:04:05Z", "yesterday": None, None: None}


def test_registry_document(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "name": "a", "maintainers": [{"name": "u", "email": "u@x"}, {"email": "nobody"}], "dist-tags": {"latest": "1.1.0"},
        "time": {"created": "2020-01-01T00:00:00Z", "modified": "2021-01-01T00:00:00Z", "1.0.0": "2020-01-01T00:00:00Z", "1.1.0": "2020-06-01T00:00:00Z"},
    }))
    docs = G.read_documents(spark, str(tmp_path))
    assert [(r.name, r.username, r.email) for r in G.owners(docs).collect()] == [("a", "u", "u@x")]
    assert {r.semver for r in G.publications(docs).collect()} == {"1.0.0", "1.1.0"}
    assert [(r.name, r.latest) for r in G.latest_tags(docs).collect()] == [("a", "1.1.0")]


class Watched(Scratch):
    """Notes the plans of what is kept."""

    def keep(self, df, name):
        self.plans = {**getattr(self, "plans", {}), name: df._jdf.queryExecution().executedPlan().toString()}
        return super().keep(df, name)


def test_a_text_is_parsed_once(spark):
    texts = [("a", json.dumps(NPM3)), ("empty", '{"packages":{}}'), ("none", '{"name":"x"}'), ("bad", "<html>"), ("null", '{"packages":{"node_modules/q":null}}')]
    made = spark.createDataFrame([(d, t[:1], t[1:]) for d, t in texts], "doc string, head string, tail string").select("doc", F.concat("head", "tail").alias("text"))
    watched = Watched(spark, "watched")
    found = L.parse_npm(made, watched)
    assert watched.plans["npm-entries"].count("from_json") == 1
    assert {r.doc for r in found.releases.collect()} == {"a"}


def test_a_manifest_is_parsed_once_for_all_sections(spark):
    manifests = [
        ("a", '{"dependencies":{"x":"^1","y":"2"},"optionalDependencies":{"x":"~3"},"devDependencies":{"z":"4"}}'), ("b", "{}"), ("c", "no JSON"), ("d", None),
        ("e", '{"devDependencies":{"z":null}}'),
    ]
    rows = L.manifest_rows(spark.createDataFrame(manifests, "doc string, manifest string"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(
        [("a", "x", "^1", False), ("a", "y", "2", False), ("a", "x", "~3", False), ("a", "z", "4", True), ("e", "z", None, True)], key=repr)
