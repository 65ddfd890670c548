"""Dependencies: manifests, versions, advisories, look-alike names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cindersift.operators.graph import shuffled
from cindersift.schema import SEVERITIES
from cindersift.storage import spread, tasks, written

# Fixed values. -------------------------------------------------------------------------------------------------------
POPULAR = (
    "requests flask django fastapi numpy pandas sqlalchemy celery boto3 pydantic uvicorn cryptography pillow pytest aiohttp httpx scipy scikit-learn matplotlib tensorflow torch "
    "lodash axios express react vue angular moment webpack babel eslint typescript mongoose sequelize jsonwebtoken passport socket.io node-fetch dotenv cors nodemailer multer ws"
).split()
COPYLEFT = "GPL-2.0 GPL-3.0 AGPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 GPL-2.0-only GPL-3.0-only AGPL-3.0-only GPL GPLv2 GPLv3 AGPL LGPL".split()
#: package, condition, severity, advisory
ADVISORIES = (
    ("django", "<4.2.0", "high", "CVE-2023-43665"), ("django", "<3.2.18", "high", "CVE-2023-24580"), ("django", "<2.2.28", "critical", "CVE-2022-28346"),
    ("flask", "<2.3.0", "medium", "CVE-2023-30861"), ("flask", "<1.0", "high", "CVE-2018-1000656"),
    ("requests", "<2.31.0", "medium", "CVE-2023-32681"), ("requests", "<2.20.0", "high", "CVE-2018-18074"),
    ("paramiko", "<3.4.0", "high", "CVE-2023-48795"), ("pillow", "<10.0.0", "high", "CVE-2023-44271"), ("pillow", "<9.3.0", "high", "CVE-2022-45199"),
    ("cryptography", "<41.0.0", "high", "CVE-2023-38325"), ("cryptography", "<39.0.0", "critical", "CVE-2023-0286"),
    ("pyjwt", "<2.4.0", "critical", "CVE-2022-29217"), ("pyjwt", "<2.1.0", "high", "CVE-2022-29218"),
    ("urllib3", "<2.0.0", "high", "CVE-2023-43804"), ("urllib3", "<1.26.5", "medium", "CVE-2021-33503"),
    ("werkzeug", "<2.3.0", "medium", "CVE-2023-23934"), ("werkzeug", "<2.0.0", "high", "CVE-2023-25577"),
    ("setuptools", "<65.5.1", "medium", "CVE-2022-40897"), ("lxml", "<4.9.0", "high", "CVE-2022-2309"), ("celery", "<5.2.2", "critical", "CVE-2021-23727"),
    ("sqlalchemy", "<2.0.0", "medium", "CVE-2019-7164"), ("bcrypt", "<4.0.0", "medium", "CVE-2022-28219"), ("aiohttp", "<3.8.5", "high", "CVE-2023-37276"), ("httpx", "<0.23.0", "medium", "CVE-2021-41945"),
    ("lodash", "<4.17.21", "high", "CVE-2021-23337"), ("lodash", "<4.17.19", "high", "CVE-2020-8203"), ("axios", "<1.6.0", "medium", "CVE-2023-45857"), ("axios", "<0.21.1", "high", "CVE-2020-28168"),
    ("express", "<4.18.0", "medium", "CVE-2022-24999"), ("express", "<4.17.3", "medium", "CVE-2022-24434"), ("jsonwebtoken", "<9.0.0", "critical", "CVE-2022-23529"), ("jsonwebtoken", "<8.5.1", "critical", "CVE-2022-23540"),
    ("next", "<14.0.0", "high", "CVE-2023-46298"), ("next", "<13.5.1", "high", "CVE-2023-46298"), ("vm2", "<3.9.19", "critical", "CVE-2023-29017"), ("vm2", "<3.9.11", "critical", "CVE-2022-36067"),
    ("tough-cookie", "<4.1.3", "critical", "CVE-2023-26136"), ("semver", "<7.5.2", "high", "CVE-2022-25883"), ("minimatch", "<3.0.5", "high", "CVE-2022-3517"), ("node-fetch", "<3.2.10", "high", "CVE-2022-0235"),
    ("passport", "<0.6.0", "critical", "CVE-2022-25896"), ("multer", "<1.4.4-lts.1", "critical", "CVE-2022-24434"), ("ws", "<7.4.6", "medium", "CVE-2021-32640"), ("tar", "<6.1.11", "critical", "CVE-2021-37701"),
    ("shelljs", "<0.8.5", "high", "CVE-2022-0144"), ("handlebars", "<4.7.7", "critical", "CVE-2021-23369"), ("handlebars", "<4.5.3", "critical", "CVE-2019-19919"), ("marked", "<4.0.10", "medium", "CVE-2022-21681"),
    ("qs", "<6.10.3", "high", "CVE-2022-24999"), ("serialize-javascript", "<6.0.0", "high", "CVE-2022-25878"), ("socket.io", "<4.6.1", "medium", "CVE-2023-31125"), ("nodemailer", "<6.6.2", "high", "CVE-2021-23400"),
    ("winston", "<3.3.3", "medium", "CVE-2021-3807"), ("acorn", "<7.4.0", "high", "CVE-2020-7754"), ("moment", "<2.29.4", "high", "CVE-2022-31129"), ("browserify-sign", "<4.2.2", "critical", "CVE-2023-46234"),
)
UNKNOWN_VERSION = "0.0.0"
MANIFESTS = ("requirements.txt", "package.json", "pyproject.toml", "Pipfile", "go.mod", "Cargo.toml")
# ---------------------------------------------------------------------------------------------------------------------


def version_parts(version: Column) -> Column:
    """The first three numbers of a version; arrays compare as versions do."""
    digits = F.split(F.regexp_replace(version, r"[^0-9.]", ""), r"\.")
    return F.transform(F.filter(F.slice(digits, 1, 3), lambda p: p != ""), lambda p: p.cast("int"))


def extracted_version(text: Column) -> Column:
    """The version in a constraint, 0.0.0 where there is none."""
    found = F.regexp_extract(text, r"[0-9]+\.[0-9]+\.?[0-9]*", 0)
    return F.when(text.isNull() | text.isin("", "*", "latest") | (found == ""), UNKNOWN_VERSION).otherwise(found)


def satisfies(version: Column, op: Column, bound: Column) -> Column:
    """D3: a version against one comparison."""
    return F.when(op == "<", version < bound).when(op == "<=", version <= bound).when(op == ">", version > bound).when(op == ">=", version >= bound).when(op == "==", version == bound).when(op == "!=", version != bound).otherwise(False)


def advisories(spark) -> DataFrame:
    table = spark.createDataFrame(list(ADVISORIES), "package string, condition string, severity string, cve_id string")
    return table.select("package", F.regexp_extract("condition", r"^([<>=!]+)", 1).alias("op"), version_parts(F.regexp_extract("condition", r"^[<>=!]+\s*([0-9.]+)", 1)).alias("bound"), "severity", "cve_id")


#: Parts of a package's versions, so that one package isn't one task, and rows of a name and version that travel as one, on average at most.
SLICES, CHUNK = 8, 1000


def vulnerable(packages: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Packages with each advisory that their version falls under; unknown versions are left out.

    A table (package, op, bound, severity, cve_id) of any size: each distinct name and version meets each distinct bound of its
    package once, in SLICES parts of a package's versions. Packages of a name and version travel as arrays of CHUNK rows, take up
    the bounds that they met, and only the last join, dealt by bound and slice over many tasks, brings in the advisories that have
    it; arrays are taken apart after it. What it gives is as large as asked: under the constant table of under a hundred rows,
    which is broadcast to the rows themselves, or under a growing one the product of both.
    """
    known = packages.where(F.col("version") != UNKNOWN_VERSION)
    if table is None:
        joined = known.join(F.broadcast(advisories(packages.sparkSession)), F.lower("name") == F.col("package"))
        return joined.where(satisfies(version_parts(F.col("version")), F.col("op"), F.col("bound"))).drop("op", "bound", "package")
    keys = {"package": "__package", "op": "__op", "bound": "__bound"}
    table = table.withColumnsRenamed(keys).where("__package is not null and __op is not null and __bound is not null")
    part = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SLICES)).cast("int")
    slices = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))
    counts = known.where("name is not null").groupBy("name", "version").agg(F.count("*").alias("__n"))
    versions = counts.select(F.lower("name").alias("__package"), F.col("version").alias("__version")).distinct().withColumns({"__slice": part("__version"), "__parts": version_parts(F.col("__version"))})
    bounds = table.select(*keys.values()).distinct().withColumn("__slice", slices)
    met = versions.join(bounds, ["__package", "__slice"]).where(satisfies(F.col("__parts"), F.col("__op"), F.col("__bound"))).drop("__slice", "__parts")
    rest = [c for c in packages.columns if c not in ("name", "version")]
    chunk = F.pmod(F.xxhash64(*packages.columns), F.ceil(F.col("__n") / CHUNK)).alias("__chunk")
    groups = known.join(counts, ["name", "version"]).groupBy("name", "version", chunk).agg(F.collect_list(F.struct(*rest) if rest else F.lit(True)).alias("__rows"))
    taken = groups.join(met, (F.lower("name") == F.col("__package")) & (F.col("version") == F.col("__version"))).withColumn("__slice", part("version", "__chunk")).drop("__version", "__chunk")
    # Few bytes here stand for many rows of the result, so neither the number of tasks nor a broadcast is left to sizes.
    on = [*keys.values(), "__slice"]
    found = table.withColumn("__slice", slices).join(spread(taken, *on).hint("shuffle_hash"), on)
    told = [c for c in table.columns if c not in on]
    found = found.select("name", "version", *told, F.explode("__rows").alias("__row"))
    return found.select(*[F.col(f"__row.{c}") if c in rest else c for c in packages.columns], *told)


OPERATORS = ("<", "<=", ">", ">=", "==", "!=")


def advisory_counts(packages: DataFrame, table: DataFrame) -> DataFrame:
    """D1, D3 for tables of thousands of bounds: (name, version, n, worst) of distinct names and versions under an advisory at all.

    No version meets a bound. A package's versions and bounds stand in one sorted run; running counts of bounds by operator and
    severity tell how many lie below, at and above each version, and these are the answers of all six operators.
    """
    points = packages.where(F.col("version") != UNKNOWN_VERSION).select(F.lower("name").alias("name"), "version").distinct().withColumn("parts", version_parts(F.col("version")))
    bounds = table.where("package is not null and bound is not null").groupBy(F.col("package").alias("name"), F.col("bound").alias("parts"))
    kinds = [(o, s) for o in OPERATORS for s in SEVERITIES]
    at = bounds.agg(*[F.count(F.when((F.col("op") == o) & (F.col("severity") == s), 1)).alias(f"{OPERATORS.index(o)}{s}") for o, s in kinds])
    here = points.select("name", "parts").distinct().join(at, ["name", "parts"], "full_outer").na.fill(0, [f"{OPERATORS.index(o)}{s}" for o, s in kinds])
    run = Window.partitionBy("name").orderBy("parts")
    below, all_ = run.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("name")
    found = {}
    for s in SEVERITIES:
        own = lambda o: F.col(f"{OPERATORS.index(o)}{s}")  # noqa: E731, B023
        before = lambda o: F.coalesce(F.sum(own(o)).over(below), F.lit(0))  # noqa: E731, B023
        total = lambda o: F.sum(own(o)).over(all_)  # noqa: E731, B023
        found[s] = (total("<") - before("<") - own("<")) + (total("<=") - before("<=")) + before(">") + (before(">=") + own(">=")) + own("==") + (total("!=") - own("!="))
    counted = here.select("name", "parts", *[c.alias(s) for s, c in found.items()])
    n = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in SEVERITIES])
    return points.join(counted, ["name", "parts"]).select("name", "version", n.alias("n"), worst.alias("worst")).where("n > 0")


#: Characters up to which a name's deletions are indexed; longer names are indexed by pieces.
LONG = 24


def _shortened(name: Column, distance: int) -> Column:
    """All texts that a name becomes by taking out up to ``distance`` characters, itself included."""

    def less(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(x))
        return F.when(F.length(x) > 0, F.transform(places, lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))

    every = last = F.array(name)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, less)))
        every = F.array_union(every, last)
    return every


def _pieces(name: Column, length: Column, distance: int, shifts: bool) -> Column:
    """(length, number, text) of the ``distance + 1`` pieces of a name of that length; with shifts, of all places that they can be met at."""
    k = distance + 1
    moves = range(-distance, distance + 1) if shifts else (0,)
    cut = lambda i: F.floor(length * i / k).cast("int")
    return F.array_distinct(F.flatten(F.array(*[F.array(*[F.struct(length.alias("length"), F.lit(i).alias("number"), F.substring(name, cut(i) + 1 + m, cut(i + 1) - cut(i)).alias("piece")) for m in moves]) for i in range(k)])))


def name_candidates(names: DataFrame, popular: DataFrame, distance: int = 2) -> DataFrame:
    """(name, popular): all pairs within an edit distance, and few others, by index instead of all with all.

    Names within the distance share a text that both become by taking out so many characters at most, so short names meet there,
    in an equality. A long name has too many such texts; of the ``distance + 1`` pieces of a long popular name one is
    untouched, so it stands in the name, moved by the distance at most. Few pairs that are not near meet either way.
    """
    near, table = names.select("name").where("name is not null").distinct(), popular.select("popular").where("popular is not null").distinct()
    short = near.where(F.length("name") <= LONG + distance).select("name", F.explode(_shortened(F.col("name"), distance)).alias("key"))
    short = short.join(table.where(F.length("popular") <= LONG).select("popular", F.explode(_shortened(F.col("popular"), distance)).alias("key")), "key").select("name", "popular")
    lengths = F.explode(F.sequence(F.length("name") - distance, F.length("name") + distance))
    long = near.where(F.length("name") > LONG - distance).select("name", lengths.alias("m")).where(F.col("m") > LONG).select("name", F.explode(_pieces(F.col("name"), F.col("m"), distance, True)).alias("p"))
    own = table.where(F.length("popular") > LONG).select("popular", F.explode(_pieces(F.col("popular"), F.length("popular"), distance, False)).alias("p"))
    long = long.join(own, "p").select("name", "popular")
    return short.unionByName(long).distinct()


def similar_names(names: DataFrame, popular: DataFrame, distance: int = 2) -> DataFrame:
    """(name, popular, d) of all distinct names and popular names at an edit distance of 1 up to ``distance``."""
    pairs = name_candidates(names, popular, distance).withColumn("d", F.levenshtein("name", "popular", distance))
    return pairs.where(F.col("d").between(1, distance))


def typosquats(packages: DataFrame, popular: tuple[str, ...] | DataFrame = tuple(POPULAR), distance: int = 2) -> DataFrame:
    """Names within the distance of a popular name but not popular themselves, and the nearest, by name on a tie.

    Popular names may be a table (popular) of any size.
    """
    table = popular if isinstance(popular, DataFrame) else packages.sparkSession.createDataFrame([(p,) for p in popular], "popular string")
    names = packages.select(F.lower("name").alias("name")).where("name is not null").distinct()
    near = names.join(table.select(F.col("popular").alias("name")).distinct(), "name", "left_anti")
    pairs = similar_names(near, table, distance)
    return pairs.groupBy("name").agg(F.min(F.struct("d", "popular")).alias("b")).select("name", F.col("b.popular").alias("popular"), F.col("b.d").alias("distance"))


def unpinned(packages: DataFrame) -> DataFrame:
    """Packages of these manifests without a version."""
    return packages.where((F.col("version") == UNKNOWN_VERSION) & F.col("manifest").isin("requirements.txt", "package.json", "Pipfile"))


def unpopular(packages: DataFrame, popular: tuple[str, ...] = tuple(POPULAR)) -> DataFrame:
    """Packages whose name is not popular."""
    return packages.where(~F.lower("name").isin(*popular))


def copyleft(packages: DataFrame, licence_col: str = "licence") -> DataFrame:
    """Packages under a copyleft licence."""
    return packages.where(F.upper(licence_col).isin(*[c.upper() for c in COPYLEFT]))


def manifest_packages(files: DataFrame) -> DataFrame:
    """(file, manifest, name, version) of all manifests among files (file, filename, content); of equal names the last counts.

    Keys need no quotes in TOML, extras in brackets are dropped, and JSON that doesn't parse gives no rows.
    """
    name, kind = F.col("filename"), "array<struct<name:string,version:string>>"
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("version"))
    # All parsers are one expression by file name, so files are read once.
    required = r"^([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?\s*([<>=!~^].+)?$"
    lines = F.filter(F.transform(F.split("content", r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(required)) & ~F.startswith(x, F.lit("#")))
    req = F.transform(lines, lambda x: pair(F.regexp_extract(x, required, 1), extracted_version(F.regexp_extract(x, required, 2))))

    none = F.create_map().cast("map<string,string>")
    json = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    plain, dev = F.coalesce(json["dependencies"], none), F.coalesce(json["devDependencies"], none)
    both = F.map_entries(F.map_concat(F.map_filter(plain, lambda k, v: ~F.map_contains_key(dev, k)), dev))
    pkg = F.transform(both, lambda e: pair(e["key"], F.when(e["value"].isin("*", "latest", ""), UNKNOWN_VERSION).otherwise(F.regexp_replace(e["value"], r"^[\^~>=]+", ""))))

    def pairs(regex: str, last_part: bool) -> Column:
        found = F.regexp_extract_all("content", F.lit(regex), F.lit(0))
        first = lambda m: F.substring_index(F.regexp_extract(m, regex, 1), "/", -1) if last_part else F.regexp_extract(m, regex, 1)
        return F.transform(found, lambda m: pair(first(m), extracted_version(F.regexp_extract(m, regex, 2))))

    toml = pairs(r"""(?m)^"?([A-Za-z0-9_.-]+)"?\s*=\s*(?:\{[^}\n]*version\s*=\s*)?["']([^"'\n]+)["']""", False)
    go = pairs(r"([a-zA-Z0-9./-]+)\s+v([0-9.]+)", True)
    found = F.when(name == "requirements.txt", req.cast(kind)).when(name == "package.json", pkg.cast(kind)).when(name == "go.mod", go.cast(kind)).otherwise(toml.cast(kind))
    out = files.where(name.isin(*MANIFESTS)).select("file", name.alias("manifest"), F.inline(found))
    return out.groupBy("file", "manifest", F.lower("name").alias("name")).agg(F.max("version").alias("version"))


def findings(files: DataFrame) -> DataFrame:
    """D1, D5, D7 as findings of the manifests among files (repo, file, filename, content): layer 4, line 0."""
    rows = manifest_packages(files.withColumn("file", F.concat_ws("\x00", "repo", "file")))
    # Written, as four readers would each parse all manifests.
    rows = written(rows.withColumns({"repo": F.substring_index("file", "\x00", 1), "file": F.substring_index("file", "\x00", -1)}), "packages")

    def told(found: DataFrame, rule: Column, issue: Column, severity: Column, sure: float, exploit: Column, blast: Column, cve: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        return found.select("repo", "file", F.lit(0).alias("line"), rule.alias("rule_id"), severity.alias("severity"), issue.alias("issue"), F.col("name").alias("matched"), exploit.alias("exploitability"), blast.alias("blast_radius"), F.lit(sure).alias("confidence"), none.alias("cwe_id"), F.lit(4).alias("layer"), F.col("name").alias("package_name"), F.col("version").alias("package_version"), cve.alias("cve_id"))

    none = F.lit(None).cast("string")
    severe = F.col("severity").isin("critical", "high")
    known = told(vulnerable(rows), F.concat(F.lit("l4/cve-"), F.replace(F.lower("cve_id"), F.lit("-"), F.lit(""))), F.concat(F.lit("Known Vulnerability in "), F.col("name"), F.lit(" — "), F.col("cve_id")), F.col("severity"), 0.92, F.when(severe, 0.75).otherwise(0.40), F.when(severe, 7).otherwise(4), F.col("cve_id"))
    # Rows of a common misspelling are dealt over slices, each of which gets the name, so one name isn't one task.
    slices = tasks(rows.sparkSession)
    near = typosquats(rows).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    near = rows.withColumn("__slice", F.pmod(F.xxhash64("repo", "file"), F.lit(slices)).cast("int")).join(shuffled(near), ["name", "__slice"])
    near = told(near, F.lit("l4/typosquat"), F.concat(F.lit("Potential Typosquatting: '"), F.col("name"), F.lit("' (did you mean '"), F.col("popular"), F.lit("'?)")), F.lit("high"), 0.75, F.lit(0.70), F.lit(9), none)
    loose = told(unpinned(rows), F.lit("l4/unpinned-dependency"), F.concat(F.lit("Unpinned Dependency: "), F.col("name")), F.lit("medium"), 0.85, F.lit(0.45), F.lit(5), none)
    return known.unionByName(near).unionByName(loose)


# The legacy scanner's packages (name, version below which it is vulnerable, severity), look-alikes and licences.
LEGACY_ADVISORIES = (
    ("django", "4.2.0", "high"), ("flask", "2.3.0", "medium"), ("requests", "2.31.0", "medium"), ("paramiko", "3.4.0", "high"), ("pillow", "10.0.0", "high"), ("cryptography", "41.0.0", "high"), ("pyjwt", "2.4.0", "critical"),
    ("urllib3", "2.0.0", "high"), ("werkzeug", "2.3.0", "medium"), ("setuptools", "65.5.1", "medium"), ("lodash", "4.17.21", "high"), ("axios", "1.6.0", "medium"), ("express", "4.18.0", "medium"), ("jsonwebtoken", "9.0.0", "critical"), ("next", "14.0.0", "high"),
)
LEGACY_LOOKALIKES = {
    "reqeusts": "requests", "requets": "requests", "requsts": "requests", "panda": "pandas", "pandsa": "pandas", "numppy": "numpy", "nupy": "numpy", "flaskk": "flask", "djnago": "django", "djangoo": "django",
    "sqlalcehmy": "sqlalchemy", "pytets": "pytest", "beautifulsup": "beautifulsoup4", "scikit-lern": "scikit-learn", "scippy": "scipy", "maplotlib": "matplotlib", "pilow": "pillow", "cryptographyy": "cryptography",
    "lodsh": "lodash", "lohash": "lodash", "monment": "moment", "momnet": "moment", "expresss": "express", "expresjs": "express", "reactt": "react", "axois": "axios", "axiso": "axios", "webpcak": "webpack",
    "babbel": "babel", "eslnt": "eslint", "typscript": "typescript", "mongosse": "mongoose", "mongose": "mongoose", "sequilize": "sequelize", "jasonwebtoken": "jsonwebtoken", "jsonwebtokn": "jsonwebtoken",
    "dotenev": "dotenv", "dotevn": "dotenv", "cors2": "cors", "nodemailler": "nodemailer", "nodmailr": "nodemailer",
}
PACKAGE_LICENCES = {"gpl": "GPL-3.0", "python-gflags": "BSD-3", "gnureadline": "GPL-3.0", "mysql-connector-python": "GPL-2.0", "mysqlclient": "GPL-2.0", "pyqt5": "GPL-3.0", "pyqt6": "GPL-3.0", "sip": "GPL-2.0", "gdb": "GPL-3.0", "ffmpeg-python": "LGPL-2.1"}


def legacy_vulnerable(packages: DataFrame) -> DataFrame:
    """Packages that the legacy scanner lists, whatever their version; its requirements need one, which is told and not compared."""
    name, manifest = F.lower("name"), F.col("manifest")
    severity = F.coalesce(*[F.when(name == n, F.lit(s)) for n, _, s in LEGACY_ADVISORIES])
    affected = F.coalesce(*[F.when(name == n, F.lit(f"< {v}")) for n, v, _ in LEGACY_ADVISORIES])
    listed = (manifest == "package.json") | (manifest.isin("requirements.txt", "Pipfile") & (F.col("version") != UNKNOWN_VERSION))
    return packages.where(listed).withColumns({"severity": severity, "affected": affected}).where("severity is not null")


def legacy_lookalikes(packages: DataFrame) -> DataFrame:
    """Packages that the legacy scanner knows as look-alikes, and of what; an underscore counts as a hyphen."""
    name = F.replace(F.lower("name"), F.lit("_"), F.lit("-"))
    popular = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in LEGACY_LOOKALIKES.items()])
    return packages.withColumn("popular", popular).where("popular is not null")


def copyleft_dependencies(packages: DataFrame) -> DataFrame:
    """Packages that are known to be under a copyleft licence, whatever their manifest says."""
    licence = F.coalesce(*[F.when(F.lower("name") == k, F.lit(v)) for k, v in PACKAGE_LICENCES.items()])
    return copyleft(packages.withColumn("known_licence", licence), "known_licence")
