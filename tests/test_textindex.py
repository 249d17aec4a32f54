"""The module index over texts made from parts whose kinds, names and ranges are known."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evlake.functions.headers import HEADER_LIMIT, TOKEN, decode_symbol, read_headers
from evlake.operators import textindex
from evlake.operators.ranges import artifact_lines, chunk_bytes
from evlake.operators.textindex import index_blocks

# Name as written -> symbol.
NAMES = {
    "@alpha": "alpha", "@_ZN4core3fmtE": "_ZN4core3fmtE", "@7": "7", '@"with space"': "with space",
    '@"br{ace}; \\22q\\22"': 'br{ace}; "q"', '@"\\E2\\82\\AC\\5Cx"': "€\\x", '@"back\\\\slash"': "back\\slash", "@a.b$c-d": "a.b$c-d",
}
BODIES = ["ret void", "%t = call i32 @callee(i32 1) ; } not a brace", 'call void asm "}{", ""()', "br label %x\n{ i8 1 }", ""]
HEADERS = [
    "define void {n}() {{", "define dso_local i64 {n}(i64 %0, ptr %1) #3 {{", "define {{ i64, ptr }} {n}([2 x i8] %v) {{",
    "define void\n  {n}(\n i8 %a) {{", 'define void {n}() section ".text.{{}}" align 16 {{',
    "define void {n}() prefix <2 x i8> <i8 1, i8 2> {{", "define i8 {n}() prologue [1 x i8] c\"x\" personality ptr @eh {{",
    "define void {n}() personality ptr addrspace(2) getelementptr (i8, ptr @t, i64 2) !dbg !9 {{", "define void {n}() prefix {{ i8 }} {{ i8 4 }} {{",
]
DIRECT = ["{n} = alias i8, ptr {t}\n", "{n} = weak_odr hidden alias [4 x i8], ptr {t}\n", '{n} = alias void (i8),\n ptr addrspace(1) {t}, partition "p"\n', "{n}\n=\nalias i8, ptr {t}\n"]
EXPRESSION = ["{n} = alias i8, inttoptr (i64 9 to ptr)\n", "{n} = internal alias i32, ptr getelementptr (i32, ptr {t}, i64 3)\n", "{n} = alias i8, ptr dso_local_equivalent {t}\n"]
IFUNC = ["{n} = ifunc i32 (i32), ptr {t}\n", "{n} = dso_local ifunc void (),\n\tptr {t}, !note !4\n"]
OTHER = ["; define void @no() {\n", "%pair = type { i8, { i8 } }\n", "declare ptr @extern(i64)\n", '@str = private constant [3 x i8] c"}{;"\n', "@arr =\n global { i8 } { i8 1 }\n",
         'module asm "define void @x() {"\n', "attributes #3 = { nounwind }\n", "!9 = !{ptr @alpha}\n", "\n", "$grp = comdat any\n"]


def module(rng, crowded):
    """A text, and (symbol, kind, target, start, length) of what it defines."""
    text, found = "", []
    for _ in range(rng.randrange(3, 25)):
        name, target = rng.choice(sorted(NAMES)), rng.choice(sorted(NAMES))
        kind = rng.choice(["function"] * 4 + ["direct_alias", "expression_alias", "ifunc", "other"])
        start = len(text.encode())
        if kind == "other":
            text += rng.choice(OTHER)
            continue
        if kind == "function":
            text += rng.choice(HEADERS).format(n=name) + rng.choice(["\n", " "]) + rng.choice(BODIES) + "\n" + "}"
            length = len(text.encode()) - start
            text += " " if crowded and rng.random() < 0.6 else rng.choice(["\n", " ; end }\n"])
            if text[-1] == " " and rng.random() < 0.2:
                text += "\n"
        else:
            forms = {"direct_alias": DIRECT, "expression_alias": EXPRESSION, "ifunc": IFUNC}[kind]
            text += rng.choice(forms).format(n=name, t=target)
            length = len(text.encode()) - start
        found.append((NAMES[name], kind, NAMES[target] if kind == "direct_alias" else None, start, length))
        if text[-1] == " ":
            # Only a definition may follow on the line.
            start = len(text.encode())
            text += "define void @tail() { ret void }"
            found.append(("tail", "function", None, start, len(text.encode()) - start))
            text += "\n"
    return text, found


def lines_of(spark, texts: dict[str, str], chunk: int):
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    chunks = chunk_bytes(df, ["name"], F.encode("text", "UTF-8"), chunk)
    return artifact_lines(chunks, ["name"], block=5)


def index(spark, texts, chunk=8192, block=1 << 18):
    definitions, errors = index_blocks(lines_of(spark, texts, chunk), ["name"], block=block)
    got: dict[str, list] = {name: [] for name in texts}
    for r in definitions.collect():
        got[r.name].append((r.raw_symbol, r.kind, r.target, r.start, r.length))
    bad: dict[str, set] = {}
    for r in errors.collect():
        bad.setdefault(r.name, set()).add((r.error, r.error_at))
    return {name: sorted(rows, key=lambda r: r[3]) for name, rows in got.items()}, bad


@pytest.mark.parametrize("chunk", [11, 8192])
def test_modules_of_known_parts(spark, chunk):
    rng = random.Random(chunk)
    made = {f"m{i}": module(rng, i % 2) for i in range(30)}
    got, bad = index(spark, {k: v[0] for k, v in made.items()}, chunk, block=97)
    assert bad == {}
    for name, (_, want) in made.items():
        assert got[name] == want, made[name][0]


BROKEN = {
    "define": ("unexpected_end", 6),
    "define i8 @w(": ("unexpected_end", 13),
    "define i8 @w() {\n": ("unclosed_body", 17),
    "define i8 @w() = {\n}\n": ("unexpected_token", 15),
    "define i8 @w([i8)] {\n}\n": ("mismatched_delimiter", 16),
    "define i8 @w() personality {\n}\n": ("unexpected_end", 31),
    "  define void @9z() {\n}\n": ("bad_symbol", 14),
    "define\nvoid @9z() {\n}\n": ("bad_symbol", 12),
    '@"\\C3" = alias i8, ptr @w\n': ("bad_symbol", 0),
    "@v = alias i8, ptr @5w\n": ("bad_symbol", 19),
    "@v = alias i8,\nptr @5w\n": ("bad_symbol", 19),
    "@v = alias , ptr @w\n": ("unexpected_token", 11),
    "@v = alias i8 ptr @w\n": ("unexpected_token", 18),
    "@v = alias i8, ptr @w @w\n": ("unexpected_token", 22),
    '@v = alias i8, ptr @w, partition 3\n': ("unexpected_token", 33),
    "@v alias i8\n": ("expected_assignment", 0),
    'define void @w() {\n call "a\\zb"\n}\n': ("bad_quoted_text", 25),
    "define void @w() {\n}\n }\n": ("unopened_brace", 21),
}


def test_errors_with_their_places(spark):
    _, bad = index(spark, {t: t for t in BROKEN})
    assert {t: e for t, (e,) in bad.items()} == BROKEN


def test_long_names_and_headers(spark):
    """Nothing is cut: a long name survives whole, and a long header is reported in every form."""
    name = "n" * (HEADER_LIMIT - 100)
    over = "o" * (HEADER_LIMIT + 100)
    texts = {"fits": f"define void @{name}() {{\n}}\n", "fits split": f"define void\n@{name}() {{\n}}\n",
             "over": f"define void @{over}() {{\n}}\n", "over split": f"define void\n@{over}() {{\n}}\n",
             "over alias": f"@a = alias i8, ptr @{over}\n", "blank": f"define{' ' * HEADER_LIMIT}\nvoid @f() {{\n}}\n"}
    got, bad = index(spark, texts, 1 << 16)
    assert [r[0] for r in got["fits"]] == [r[0] for r in got["fits split"]] == [name]
    assert {k: {e for e, _ in v} for k, v in bad.items()} == {k: {"header_too_long"} for k in texts if not k.startswith("fits")}


def test_long_lines(spark):
    filler = "y" * 90_000
    text = (
        f'@s = constant [90000 x i8] c"{filler}"\n@t = global {{ i8 }} {"{ i8 3 }, " * 4000}\n'
        f'define void @w() {{\n ; {filler} }}\n call void asm "{filler}}}", ""()\n}}\n'
    )
    got, bad = index(spark, {"long": text}, 1 << 16)
    assert got["long"] == [("w", "function", None, text.index("define"), len(text) - 1 - text.index("define"))]
    assert bad == {}


def test_lines_in_segments(spark, monkeypatch):
    """Lines of many segments of a few chunks: quotes, escapes, comments and braces on every border."""
    monkeypatch.setattr(textindex, "SEGMENT", 64)
    rng = random.Random(5)
    parts = ["{ i8 1 }, ", '"}{" ', '"a\\22}\\\\{" ', "i8 %x ", "[2 x i8] ", '"long quoted ' + "}{;" * 40 + '" ', "call @f() "]
    texts, wanted = {}, {}
    for i in range(25):
        body = "".join(rng.choice(parts) for _ in range(rng.randrange(20, 120)))
        line = body + rng.choice(["", "; a comment }} { " * 20])
        text = f"define void @w{i}() {{\n {line}\n}}\n@c = constant [9 x i8] {line}\ndefine void @v() {{\n {body}\n}}\n"
        second = text.rindex("define")
        texts[f"t{i}"] = text
        wanted[f"t{i}"] = [(f"w{i}", "function", None, 0, text.index("\n}\n") + 2), ("v", "function", None, second, len(text) - 1 - second)]
    got, bad = index(spark, texts, chunk=13, block=50)
    assert bad == {}
    assert got == wanted


def test_a_line_of_a_thousand_chunks(spark):
    filler = '{ i8 1 }, "}\\22{", ' * 40_000
    text = f"define void @w() {{\n {filler}; }}}}\n}}\n@v = alias i8, ptr @w\n"
    assert len(filler) > 700 * 1024
    got, bad = index(spark, {"long": text}, 700)
    end = text.index("\n}\n") + 2
    assert bad == {}
    assert got["long"] == [("w", "function", None, 0, end), ("v", "direct_alias", "w", end + 1, len(text) - end - 1)]


def test_faults_in_segments(spark, monkeypatch):
    monkeypatch.setattr(textindex, "SEGMENT", 32)
    pad = "i8 %x, " * 30
    texts = {"bad quote": f'define void @w() {{\n {pad}"a\\zb"\n}}\n'}
    _, bad = index(spark, texts, 7)
    assert bad["bad quote"] == {("bad_quoted_text", texts["bad quote"].index('"'))}
    # A second definition right behind the end of a segment is refused, not lost.
    texts = {f"t{n}": "define void @w() {" + "x" * n + " ret void } define void @v() { ret void }" + " " * 60 + "\n" for n in range(30)}
    got, bad = index(spark, texts, 7)
    assert all(("line_too_long", 35) in bad[f"t{n}"] for n in range(7))
    for name in texts:
        assert [r[0] for r in got[name]] == ["w", "v"] or ("line_too_long", 35) in bad[name], texts[name]


def test_reading_is_linear(spark):
    texts = [(i, "define void @w() " + "word " * 250_000) for i in range(2)]
    started = time.perf_counter()
    found = read_headers(spark.createDataFrame(texts, "id int, text string"), ["id"]).collect()
    assert {r.error for r in found} == {"header_too_long"}
    assert time.perf_counter() - started < 60


def test_headers_of_one_line_and_flat_groups_are_cheap(spark):
    """Whole groups are one token, and the disassembler's one-line forms need no token rows."""
    lines = {
        "define { i8, ptr } @f(ptr %x) prefix { i32 } { i32 7 } {\n": "function",
        "define { i64, ptr } @f(i8 %a) {\n": "function",
        "@e = alias i8, getelementptr (i8, ptr @f, i64 1)\n": "expression_alias",
        "define [2 x ( i8] @f() {\n": "header", "define void @f() prefix i8 {\n": "header", "define {} @f( () {\n": "header",
    }
    df = spark.createDataFrame([(i, 0, t.encode()) for i, t in enumerate(lines)], "name int, byte_start bigint, line binary")
    rows = textindex._features(textindex._segments(df, ["name"]), ["name"]).orderBy("name").collect()
    assert [r.form for r in rows] == list(lines.values())
    text = spark.createDataFrame([(next(iter(lines)),)], "t string")
    assert text.select(F.size(F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)))).first()[0] < 12


def test_stray_delimiters_before_a_name(spark):
    texts = {t: t for t in ("define > void @w() {\n}\n", "define [2 x ( i8] @w() {\n}\n", "define void @w( () {\n}\n")}
    got, bad = index(spark, texts)
    assert not any(got.values()) and set(bad) == set(texts)


def test_symbols(spark):
    tokens = NAMES | {"@": None, "@4x": None, '@"\\FF"': None, '@""': None, '@"open': None, "@" + "z" * 2_000_000: "z" * 2_000_000}
    df = spark.createDataFrame([(t.encode().decode("latin-1"),) for t in tokens], "t string")
    got = {r.t: r.s for r in df.select("t", decode_symbol(F.col("t")).alias("s")).collect()}
    assert got == tokens
