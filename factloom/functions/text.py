"""Scalar functions as column expressions; those that need a byte-wise hash or a scanner are Arrow UDFs in scan.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that str.trim() of other engines removes; SQL's TRIM only takes spaces.
BLANKS = " \t\n\r"

#: JavaScript's reserved words (fixed values).
KEYWORDS = (
    "async await break case catch class const continue debugger default delete do else enum export extends false finally for function "
    "if implements import in instanceof interface let new null package private protected public return static super switch this throw "
    "true try typeof var void while with yield"
).split()
#: Modules that Node.js brings along (fixed values).
NODE_BUILTINS = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 "
    "https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls "
    "trace_events tty url util v8 vm wasi worker_threads zlib"
).split()


def blank_to_null(c: Column) -> Column:
    """Blank strings mean nothing is there."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def slugify(c: Column, default: str = "module") -> Column:
    """Runs of other characters than A-Z, a-z, 0-9, _, / and - become one dash; dashes at the ends go."""
    slug = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_/-]+", "-"), "-{2,}", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", default).otherwise(slug)


def module_path(module_id: Column, name: Column, extension: Column) -> Column:
    """modules/<id>-<slug>.<extension>: unique by the id whatever the name."""
    return F.concat(F.lit("modules/"), module_id.cast("string"), F.lit("-"), slugify(name), F.lit("."), F.coalesce(extension, F.lit("ts")))


def specifier_package(c: Column) -> Column:
    """The package of a bare import specifier, scope included; null for relative, absolute and URL-like ones."""
    bare = F.regexp_extract(c, r"^((?:@[^/@\s]+/)?[^./@\s:][^/@\s:]*)(?:/.*)?$", 1)
    return F.nullif(bare, F.lit(""))


def specifier_subpath(c: Column) -> Column:
    """What follows the package in a bare specifier, or null."""
    return F.nullif(F.regexp_extract(c, r"^(?:@[^/@\s]+/)?[^./@\s:][^/@\s:]*/(.+)$", 1), F.lit(""))


def is_node_builtin(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:node:)?([a-z_0-9]+)(?:/.*)?$", 1).isin(NODE_BUILTINS)


def semver(c: Column) -> Column:
    """struct(major, minor, patch, rank, pre) in version order; null where the text is no exact version. A release ranks over its pre-releases."""
    pattern = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    pre = part(4)
    parsed = F.struct(
        part(1).try_cast("int").alias("major"), part(2).try_cast("int").alias("minor"), part(3).try_cast("int").alias("patch"),
        F.when(pre == "", 1).otherwise(0).alias("rank"), pre.alias("pre"),
    )
    return F.when(c.rlike(pattern), parsed)


def range_bounds(requirement: Column) -> Column:
    """struct(low, high) of (major, minor, patch) triples, low inclusive and high exclusive, for =, ^, ~, <, <=, >, >=, * and latest."""
    text = F.btrim(requirement, F.lit(BLANKS))
    op = F.regexp_extract(text, r"^(\^|~|<=|>=|<|>|=)?", 1)
    number = lambda i: F.coalesce(F.regexp_extract(text, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("int"), F.lit(0))
    a, b, c = number(1), number(2), number(3)
    given = F.regexp_extract(text, r"^[~^<>=]*\s*v?(\d+(?:\.\d+)*)", 1)
    depth = F.when(given == "", 0).otherwise(F.size(F.split(given, "\\.")))
    triple = lambda x, y, z: F.struct(F.lit(x).alias("major") if isinstance(x, int) else x.alias("major"), F.lit(y).alias("minor") if isinstance(y, int) else y.alias("minor"), F.lit(z).alias("patch") if isinstance(z, int) else z.alias("patch"))
    top, zero = triple(2**31 - 1, 0, 0), triple(0, 0, 0)
    this, after = triple(a, b, c), triple(a, b, c + 1)
    next_major, next_minor = triple(a + 1, 0, 0), triple(a, b + 1, 0)
    caret = F.when(a > 0, next_major).when((b > 0) & (depth >= 2), next_minor).when(depth >= 3, after).when(depth == 2, next_minor).otherwise(next_major)
    partial = F.when(depth == 1, next_major).when(depth == 2, next_minor).otherwise(after)
    high = F.when(text.isin("*", "latest", "", "x"), top).when(op == "^", caret).when(op == "~", F.when(depth == 1, next_major).otherwise(next_minor)).when(op == "<", this).when(op == "<=", partial).when(op.isin(">", ">="), top).otherwise(partial)
    low = F.when(text.isin("*", "latest", "", "x") | op.isin("<", "<="), zero).when(op == ">", partial).otherwise(this)
    return F.struct(low.alias("low"), high.alias("high"))


def is_minified(c: Column) -> Column:
    """Names as minifiers make them: up to two characters, a $ anywhere, or up to four without a vowel or with a figure."""
    name = F.btrim(c, F.lit(BLANKS))
    n = F.char_length(name)
    return (n > 0) & ((n <= 2) | name.contains("$") | ((n <= 4) & (~name.rlike("[aeiouAEIOU]") | name.rlike("[0-9]"))))


def is_placeholder(c: Column) -> Column:
    """Names that were made up mechanically."""
    name = F.btrim(c, F.lit(BLANKS))
    return name.rlike(r"^semantic(?:Function|Class|Import|Constant|Type|Value)(?:[1-9]\d*)?$") | name.rlike(r"^module\d+SemanticSymbol\d+$")


def is_keyword(c: Column) -> Column:
    return c.isin(KEYWORDS)


def sanitized_identifier(c: Column) -> Column:
    """An identifier made of any text: other characters become _, a leading figure or a keyword gets one in front."""
    name = F.regexp_replace(F.btrim(c, F.lit(BLANKS)), "[^A-Za-z0-9_$]", "_")
    return F.when(name == "", "_").when(name.rlike("^[0-9]") | is_keyword(name), F.concat(F.lit("_"), name)).otherwise(name)


def name_tokens(c: Column) -> Column:
    """Lower-case parts of a camelCase, snake_case or dotted name; parts of figures alone are left out."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.split(F.lower(spaced), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (t != "") & ~t.rlike("^[0-9]+$"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """The share of a's elements that b has; 0 for an empty a."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set's size."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of one length; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def size_prior(a: Column, b: Column) -> Column:
    """1 for equal sizes, down to 0.1; 0.5 where either is unknown."""
    return F.when((a == 0) | (b == 0), 0.5).otherwise(F.greatest(1 - F.abs(a - b) / (a + b), F.lit(0.1)))


def name_match(a: Column, b: Column) -> Column:
    """exact, fuzzy (at least half of all parts shared) or miss."""
    return F.when(F.lower(a) == F.lower(b), "exact").when(jaccard(name_tokens(a), name_tokens(b)) >= 0.5, "fuzzy").otherwise("miss")


def cooccurring_pairs(anchors: Column, first: int = 48, most: int = 256) -> Column:
    """Pairs "a|b", a before b, of the first anchors in order; the first pairs of them."""
    head = F.slice(F.array_sort(F.array_distinct(anchors)), 1, first)
    pairs = F.flatten(F.transform(head, lambda x, i: F.transform(F.slice(head, i + 2, first), lambda y: F.concat(x, F.lit("|"), y))))
    return F.slice(pairs, 1, most)


def normalized_path(c: Column) -> Column:
    """A path without ., empty and resolved .. segments; .. that lead out stay in front."""
    step = lambda acc, s: (
        F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def resolution_candidates(base: Column, specifier: Column, extensions: tuple[str, ...] = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".json", "/index.js", "/index.ts")) -> Column:
    """Where a relative specifier in file `base` may point, in order of preference."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    path = normalized_path(F.concat(folder, specifier))
    return F.transform(F.array(*[F.lit(e) for e in extensions]), lambda e: F.concat(path, e))


def is_safe_path(c: Column) -> Column:
    """Relative, without .., drive letters, back slashes or control characters."""
    return c.isNotNull() & (c != "") & ~c.rlike(r"^[/~]|^[A-Za-z]:|\\|(?:^|/)\.\.(?:/|$)|[\x00-\x1f]")


def path_tokens(c: Column) -> Column:
    """Segments of a path without build folders, versions of extensions and index files."""
    parts = F.transform(F.split(F.lower(c), "/"), lambda s: F.regexp_replace(s, r"\.(?:d\.)?[cm]?[jt]sx?$", ""))
    return F.filter(parts, lambda s: ~s.isin("", ".", "..", "dist", "lib", "build", "src", "esm", "cjs", "umd", "es", "index", "node_modules"))


def is_vendored(path: Column) -> Column:
    return path.contains("/node_modules/") | path.startswith("node_modules/") | path.contains("/vendor/") | path.startswith("vendor/")


def asset_kind(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.rlike(r"\.wasm$"), "wasm").when(p.rlike(r"\.(?:node|so|dll|dylib)$"), "native").when(p.rlike(r"\.(?:json|ya?ml|toml)$"), "data").when(p.rlike(r"\.(?:png|jpe?g|gif|svg|ico|webp|woff2?|ttf)$"), "media").otherwise("other")


def module_kind(category: Column) -> Column:
    """Known categories as they are; blank, null and unknown ones are application code."""
    c = F.lower(blank_to_null(category))
    return F.when(c.isin("package", "builtin", "runtime", "asset"), c).otherwise("application")
