"""The given tables as corpora.

``documents``, ``pages`` and ``conversations`` are texts already.  Code,
``.env`` files and manifests are derived row by row from ``part`` and
``customer``, so they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codesift.functions import text as tx
from codesift.sources.corpus import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(df: DataFrame, file_id: Column, path: Column, text: Column) -> DataFrame:
    # Spread before paths and texts are made, so that all cores make them.
    rows = spread(df.withColumn("file_id", file_id.cast("long")))
    rows = rows.select("file_id", path.alias("path"), text.alias("text"))
    return rows.select(
        "file_id", "path", tx.extension(F.col("path")).alias("ext"),
        F.length("text").cast("long").alias("size"), "text")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return _files(table(spark, sf_dir, "documents"), F.col("doc_id"), path, F.col("text"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*", "")
    return _files(table(spark, sf_dir, "pages"), F.col("page_id"), path, F.col("html"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    path = F.concat(F.lit("conv/"), conv, F.lit("/"), turn, F.lit(".txt"))
    return _files(
        table(spark, sf_dir, "conversations"), F.col("conv_id") * (1 << 20) + F.col("turn"), path, F.col("text"))


# Eight kinds of Python file, by part key modulo 8.
CODE_KINDS = [
    "x = 1\n",
    "import hashlib\nh = hashlib.md5(b)\n",
    'q = request.args.get("a")\nz = 1\ncursor.execute(q)\n',
    "f = open(p)\n",
    'password = "{brand}"\n',
    "def (\n",
    'q = request.args.get("a")\nz = 1\nr = q\ns = 2\ncursor.execute(r)\n',
    "def f():\n  try:\n    pass\n  except:\n    pass\n",
]

# Richer Python files for control flow and rules, by part key modulo 6.
FLOW_KINDS = [
    "import os\ndef load(name):\n    auth(name)\n    path = request.args.get(name)\n    pad = 1\n"
    "    os.system(path)\n    done(name)\n    return name\nload('{brand}')\n",
    "def inner(v):\n    helper(v)\n    return v\ndef helper(v):\n    open(v)\n    return v\ndef lost(v):\n    inner(v)\n    return v\ninner(1)\n",
    "import random\ndef pick(v):\n    if v:\n        v = 1\n    if v > 1:\n        v = 2\n    if v > 2:\n        v = 3\n"
    "    q = request.form.get(v)\n    pad = 1\n    cursor.execute(q)\n    return random.randint(1, 6)\n",
    "class Box:\n    def get(self, k):\n        with open(k) as f:\n            return f.read()\n    def run(self, s):\n        return eval(s)\n"
    "token = '{brand}'\n",
    "cursor.execute('select %s' % name)\ncursor.execute('select 1')\ndb.execute(f'drop {{t}}')\nvalue = input()\neval(value)\n",
    "from Crypto.Cipher.DES import new\nimport pickle\ndef read(b):\n    try:\n        return pickle.loads(b)\n    except Exception:\n        return None\n",
]

# Chains of Python files that call each other, by part key modulo 8: each way to
# name a function of another file.  ``k`` is the file, ``n`` the next one of its
# chain, ``b`` the chain.
LINK_KINDS = [
    "from line.b{b}.m{n} import f{n}\ndef f{k}(x):\n    return f{n}(x)\n",
    "from line.b{b}.m{n} import f{n} as step\ndef f{k}(x):\n    return step(x)\n",
    "import line.b{b}.m{n}\ndef f{k}(x):\n    return line.b{b}.m{n}.f{n}(x)\n",
    "import line.b{b}.m{n} as after\ndef f{k}(x):\n    return after.f{n}(x)\n",
    "from line.b{b} import m{n}\ndef f{k}(x):\n    return m{n}.f{n}(x)\n",
    "from .m{n} import f{n}\ndef f{k}(x):\n    return f{n}(x)\n",
    "from . import m{n} as after\ndef f{k}(x):\n    return after.f{n}(x)\n",
    "from ..b{b}.m{n} import *\ndef f{k}(x):\n    return f{n}(x)\n",
]
# Files of one chain; each chain ends in a call of its own first function, so it
# is a cycle, and every third chain is entered from the top of its first file.
CHAIN = 1000
ENTERED = 3

# One line per rule group and form, by part key modulo their number.
SNIPPETS = [
    ("py", 'import os\nos.system("{brand}")\nsubprocess.call(cmd)'),
    ("py", 'cursor.execute(f"select {brand}")'),
    ("py", "data = pickle.loads(blob)\nprint(password)"),
    ("py", 'r = requests.get(url)\napp.run(host, debug=True)'),
    ("js", "document.write(x)\nvar t = Math.random()"),
    ("js", 'const apiKey = "{brand}";\neval(code + 1)'),
    ("js", 'window.addEventListener("message", f)\nlocation.href = jwt.decode(t)'),
    ("php", "<?php\necho $_GET['{brand}'];\ninclude($page);"),
    ("php", "unserialize($x); session_id($y); move_uploaded_file($z, $w);"),
    ("java", 'String token = "{brand}";\nnew ProcessBuilder(cmd);'),
    ("java", 'st.executeQuery("SELECT 1");\nnew File(base + name);\nMD5.getInstance();'),
    ("c", "strcpy(a, b);\nchar *p = malloc(n * 4);\nfree(p);"),
    ("c", "printf(fmt);\nsystem(cmd);\nq->next = 0;"),
    ("cpp", "int count;\nauto p = reinterpret_cast<int*>(q);\nnew Foo(1);"),
    ("go", 'import "math/rand"\nexec.Command(name)\nsecret := "{brand}"'),
    ("go", "db.Query(sql)\nos.Open(path)"),
    ("rb", "`ls {brand}`\nUser.update(params[:user])\ndb.execute(a + b)"),
    ("ts", 'const password = "{brand}";\n// TODO fix security hole'),
    ("sql", "-- see http://10.1.2.3/{brand}\nselect MD5(x)"),
    ("xml", "<a>-----BEGIN RSA PRIVATE KEY-----</a>\n<b>credit card</b>"),
    ("kt", "// auth bypass for {brand}\nval s = sign(secret)"),
]


def _pick(key: Column, texts: list[str], brand: Column) -> Column:
    """The text of ``key`` modulo their number, with the brand filled in."""
    table_ = F.array(*[F.lit(t.replace("{{", "{").replace("}}", "}")) for t in texts])
    chosen = F.get(table_, F.pmod(key, F.lit(len(texts))).cast("int"))
    return F.replace(chosen, F.lit("{brand}"), brand)


def _part_file(name: str, ext: Column | str) -> Column:
    key = F.col("p_partkey").cast("string")
    ext = F.lit(ext) if isinstance(ext, str) else ext
    return F.concat(F.lit("repo"), F.pmod("p_partkey", F.lit(97)).cast("string"), F.lit(f"/{name}"), key, F.lit("."), ext)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "part"), F.col("p_partkey"), _part_file("mod", "py"),
                  _pick(F.col("p_partkey"), CODE_KINDS, F.col("p_brand")))


def flow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(table(spark, sf_dir, "part"), F.col("p_partkey"), _part_file("app", "py"),
                  _pick(F.col("p_partkey"), FLOW_KINDS, F.col("p_brand")))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per part that calls the next one of its chain; a function ``g``
    in each calls the chain but is called by nothing."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    most = parts.agg(F.max("p_partkey")).first()[0] or 0
    chain = F.floor(F.col("p_partkey") / CHAIN).cast("long")
    last = F.least((chain + 1) * CHAIN - 1, F.lit(most))
    k, b = F.col("p_partkey"), chain.cast("string")
    n = F.when(k == last, chain * CHAIN).otherwise(k + 1).cast("string")
    text = F.get(F.array(*[F.lit(t) for t in LINK_KINDS]), F.pmod(k, F.lit(len(LINK_KINDS))).cast("int"))
    text = F.concat(text, F.lit("def g{k}(x):\n    return f{k}(x)\n"))
    entered = (F.pmod(chain, F.lit(ENTERED)) == 0) & (k == chain * CHAIN)
    text = F.when(entered, F.concat(text, F.lit("f{k}(1)\n"))).otherwise(text)
    for name, value in (("k", k.cast("string")), ("n", n), ("b", b)):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    path = F.concat(F.lit("repo/line/b"), b, F.lit("/m"), k.cast("string"), F.lit(".py"))
    return _files(parts, k, path, text)


def polyglot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = F.array(*[F.lit(e) for e, _ in SNIPPETS])
    ext = F.get(exts, F.pmod("p_partkey", F.lit(len(SNIPPETS))).cast("int"))
    return _files(table(spark, sf_dir, "part"), F.col("p_partkey"), _part_file("src", ext),
                  _pick(F.col("p_partkey"), [t for _, t in SNIPPETS], F.col("p_brand")))


def env_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``.env`` files from customers: comments, blanks, empty and long values."""
    key, acct = F.col("c_custkey").cast("string"), F.format_string("%.2f", "c_acctbal")
    lines = [
        F.concat(F.lit("# settings of "), "c_name"), F.lit(""),
        F.concat(F.lit("DB_PASSWORD="), "c_name"),
        F.concat(F.lit("  api_key = k="), acct, F.lit("  ")),
        F.concat(F.lit("AUTH_URL=http://h/"), key),
        F.concat(F.lit("PIN_HASH="), key),
        F.lit("SECRET="),
        F.concat(F.lit("SEGMENT="), "c_mktsegment"),
        F.concat(F.lit("ACCESS_KEY="), F.left("c_mktsegment", F.lit(4))),
        F.lit("no pair here"),
    ]
    path = F.concat(F.lit("app"), key, F.lit("/prod.env"))
    return _files(table(spark, sf_dir, "customer"), F.col("c_custkey"), path, F.concat_ws("\n", *lines))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per part; the format is the part key modulo their number,
    the version ``(key % 7).(key % 25).(key % 30)``."""
    k = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    version = F.concat_ws(".", *[F.pmod(k, F.lit(n)).cast("string") for n in (7, 25, 30)])
    names = F.array(*[F.lit(n) for n, _ in MANIFESTS])
    texts = F.array(*[F.lit(t) for _, t in MANIFESTS])
    at = F.pmod(k, F.lit(len(MANIFESTS))).cast("int")
    text = F.replace(F.replace(F.get(texts, at), F.lit("{name}"), name), F.lit("{version}"), version)
    path = F.concat(F.lit("proj"), k.cast("string"), F.lit("/"), F.get(names, at))
    return _files(table(spark, sf_dir, "part"), k, path, text)


# Versions of the generated feed: ``a.b.c`` below 50 each, by their number.
VERSIONS = 125_000


def _numbered_version(n: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.floor(n / w), F.lit(50)).cast("string") for w in (2500, 50, 1)])


def _feed_package(key: Column) -> Column:
    """A third of all rows are about one package."""
    return F.when(F.pmod(key, F.lit(3)) == 0, F.lit("left-pad")).otherwise(F.concat(F.lit("pkg"), F.pmod(key, F.lit(1000)).cast("string")))


def feed_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advisory per order: ranges, upper and lower bounds, single versions."""
    k = F.col("o_orderkey")
    low = F.pmod(k * 6947, F.lit(VERSIONS))
    first = _numbered_version(low)
    last, middle, top = (_numbered_version(F.least(low + more, F.lit(VERSIONS - 1))) for more in (F.pmod(k, F.lit(5)), F.lit(2), F.lit(6)))
    entries = F.array(
        F.array(F.concat(first, F.lit("-"), last)), F.array(F.concat(F.lit("<=0.0."), F.pmod(k, F.lit(7)).cast("string"))),
        F.array(first, F.concat(F.lit(">49.49.4"), F.pmod(k, F.lit(10)).cast("string"))),
        F.array(F.concat(first, F.lit("-"), last), F.concat(middle, F.lit("-"), top)))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("ADV-"), k.cast("string")).alias("id"), F.lit("javascript").alias("language"), _feed_package(k).alias("package"),
        F.get(entries, F.pmod(F.floor(k / 4), F.lit(4)).cast("int")).alias("affected_versions"), F.array(F.lit("99")).alias("patched_versions"),
        F.lit("High").alias("severity"), F.lit("t").alias("title"), F.lit("d").alias("description"),
        F.array(F.lit("r")).alias("references"), F.to_date("o_orderdate").alias("published_date"))


def locked_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dependency per order line, as ``read_dependencies`` gives them."""
    n = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104_729 + F.col("l_partkey") * 31, F.lit(VERSIONS))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.concat(F.lit("app"), F.col("l_orderkey").cast("string"), F.lit("/yarn.lock")).alias("path"),
        F.col("l_linenumber").cast("int").alias("dep_no"), _feed_package(F.col("l_partkey")).alias("name"), _numbered_version(n).alias("version"),
        F.lit("").alias("version_constraint"), F.lit("javascript").alias("language"), F.lit("yarn.lock").alias("source"))


# Manifest name and text; every text names the part and one known package.
MANIFESTS = [
    ("requirements.txt", "# pinned\n{name}=={version}\nrequests<={version}  # note\ngit+https://x/y\nurllib3\nflask~=2.0 ; extra\n"),
    ("setup.py", "from setuptools import setup\nsetup(install_requires=['{name}>={version}',\n  \"jinja2=={version}\", 'six'])\n"),
    ("pyproject.toml", "[tool.poetry.dependencies]\npython = \"^3.9\"\n{name} = \"{version}\"\nurllib3 = {version = \"{version}\", extras = [\"s\"]}\nlocal = {path = \".\"}\n\n[project]\nname = \"p\"\ndependencies = [\"requests>={version}\", \"x[y]<2\"]\n"),
    ("Pipfile", "[packages]\nrequests = \"{version}\"\n{name} = {git = \"x\"}\n\n[dev-packages]\npytest = \"*\"\n"),
    ("Pipfile.lock", "{\"default\": {\"requests\": {\"version\": \"=={version}\"}}, \"develop\": {\"{name}\": {\"hashes\": []}}}"),
    ("package.json", "{\"dependencies\": {\"lodash\": \"^{version}\", \"{name}\": \"{version}\"}, \"devDependencies\": {\"jquery\": \"{version}\"}}"),
    ("package-lock.json", "{\"packages\": {\"\": {\"name\": \"r\"}, \"node_modules/jquery\": {\"version\": \"{version}\"}, \"node_modules/@s/{name}\": {\"version\": \"1.0\"}}}"),
    ("npm-shrinkwrap.json", "{\"dependencies\": {\"lodash\": {\"version\": \"{version}\"}}}"),
    ("yarn.lock", "# yarn\n\nlodash@^4.0.0:\n  version \"{version}\"\n\n{name}@1:\n  version \"1.0.0\"\n"),
    ("composer.json", "{\"require\": {\"php\": \">=7\", \"symfony/security-http\": \"{version}\"}, \"require-dev\": {\"{name}\": \"*\"}}"),
    ("composer.lock", "{\"packages\": [{\"name\": \"symfony/security-http\", \"version\": \"v{version}\"}, {\"name\": \"{name}\"}]}"),
    ("pom.xml", "<project><dependencies>\n<dependency><groupId>org.apache.logging.log4j</groupId>\n<artifactId>log4j-core</artifactId><version>{version}</version></dependency>\n<dependency><groupId>g</groupId><artifactId>{name}</artifactId></dependency>\n<dependency><groupId>only</groupId></dependency>\n</dependencies></project>"),
    ("build.gradle", "dependencies {\n  implementation 'org.apache.logging.log4j:log4j-core:{version}'\n  api \"g:{name}:1.0\"\n}\n"),
    ("build.gradle.kts", "dependencies {\n  testCompile 'g:{name}:{version}'\n}\n"),
    ("app.csproj", "<ItemGroup>\n<PackageReference Include=\"Newtonsoft.Json\" Version=\"{version}\" />\n</ItemGroup>"),
    ("packages.config", "<packages>\n<package id=\"Newtonsoft.Json\" version=\"{version}\" />\n</packages>"),
    ("project.json", "{\"dependencies\": {\"Newtonsoft.Json\": \"{version}\", \"{name}\": {\"version\": \"2\"}}}"),
    ("go.mod", "module m\n\nrequire github.com/gin-gonic/gin v{version}\nrequire (\n\texample.com/{name} v1.2.3 // indirect\n\tother.org/b v0.1\n)\n"),
    ("go.sum", "github.com/gin-gonic/gin v{version} h1:abc=\nexample.com/v1.2.3 v1.0 h1:x\nexample.com/{name} h1:zz\n"),
    ("Gopkg.toml", "[[constraint]]\n  name = \"github.com/gin-gonic/gin\"\n  version = \"{version}\"\n[[constraint]]\n  name = \"example.com/{name}\"\n"),
    ("Gopkg.lock", "[[projects]]\n  name = \"github.com/gin-gonic/gin\"\n  version = \"v{version}\"\n\n[[projects]]\n  name = \"example.com/{name}\"\n"),
    ("README.md", "{name}=={version}\n"),
]
