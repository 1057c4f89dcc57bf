"""Tokens, source files, pages."""

import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import encode, handwritten, spam, syntax
from plumbline.llm.handwritten import Library, kind, notices
from plumbline.llm.queries import QUERIES

PHP_GOOD = [
    "<?php class A { public function __construct(private ?int $a = null, protected readonly array|null $b = [],) {} abstract function f(): ?static; const X = 1, Y = self::X << 2; use T, U { T::a as protected b; } public static ?B $z = null; function list() { return $this->list[0]?->x::class; } }",
    "<?php if ($a): ?> x <?php elseif ($b): ?> y <?php else: ?> z <?php endif ?>",
    '<?php switch ($a) { case 1: case "b": echo 1; break; default: return; } $f = fn(int $x): int => $x * 2; $g = static function () use (&$a): ?int { return null; };',
    '<?php namespace A\\B; use X\\{A, B as C}; enum S: string { case A = "a"; } echo match(true) { $a > 1, $b => 1, default => throw new E("x") };',
    '<?php function &g(int ...$xs) { $x = yield $k => $v; yield from f(...$xs); } echo "a {$b["c"]}", <<<X\n a {$c->d} ( [\n X . "x"; for ($i = 0; $i < 3; $i++): endfor; do { } while (0);',
    "<?php return; ", "html <?= $x ?>", "<?php echo 1; __halt_compiler(); ((( [ never closed", "﻿<?php\r\n/* { ( */ $a = '}';\r\n",
]
PHP_BAD = ["<?php if ($a) { echo 1;", "<?php $a = ;", "<?php echo 1 echo 2;", '<?php $a = "x;', "<?php /* x", "<?php f(1,,2);", "plain", "", "<?php } ", "<?php foreach ($a) { }", "<?php\n<<<<<<< HEAD\n$a = 1;\n", "<?php return $x", "<?php class A { $x = 1; }", "<?php global $wpdb\n$x = 1;"]
JS_GOOD = [
    "var a = 1, b\nlet {c, d: [e = 2, ...f]} = x\nif (a) b(); else c()\nfor (const k of ks) {} for (;;) { break }\n",
    '(function(){"use strict";return function(a,b){return a?b:a?{x:1,"y":2,[z]:3,get q(){return 1},async *g(){}}:[1,,2]}})();',
    "class A extends B.C { static x = 1; #p; constructor() { super(); } static { } }", "var r = /a[/]b/g.test(x), s = a / b / c; x = y\n++z;",
    "`a ${b + `c ${d}`} e`; a?.b?.[c]?.(d); a ??= b;", "a\n.b()\n.c(function () {\n})\n", "", "// only", "t=t?{k:1,f:!0}:[1,k];e.on('x',function(h){h.stop(),l.x(z)});",
]
JS_BAD = ["return 1;", "export default 1", "var a = ;", '{"a": 1, "b": 2}', "<div>x</div>", "a b", "`a", "foo(1, 2", ".a { width: 1px; }", "<?php echo 1;", "var 1a = 2;", "1 = x", "else {}"]


@pytest.mark.parametrize("language,good,bad", [("php", PHP_GOOD, PHP_BAD), ("js", JS_GOOD, JS_BAD), ("json", ['{"a": [1, null]}', "﻿[]", "1"], ["", "{a: 1}", "[1,]", "NaN", '{"a": 1'])])
def test_grammars(language, good, bad):
    assert [x for x in good if syntax.parses(x, language)] == []
    assert [x for x in bad if not syntax.parses(x, language)] == []


@pytest.mark.parametrize("text,claimed,fault,accepts", [('{"a": [1]}', "php", "no_open_tag", ["json"]), ("[1, 2]", "json", None, ["json", "js"]), (".a { color: red; }\n@media print { .b { margin: 0 } }", "js", "wrong_ending", ["css"]), ("a { b", "php", "no_open_tag", []), ("var a = 1;", None, None, ["js"]), ("{{{", "css", None, [])])
def test_every_grammar_is_asked(text, claimed, fault, accepts):
    valid, told, reads, _, accepted = syntax.judge(text, claimed)
    assert told == fault and sorted(accepted) == sorted(accepts) and reads == (accepted[0] if accepted else None) or claimed == "json" and valid


def test_deep_nesting_and_garbage_end():
    deep = "<?php $a = " + "(" * 3000 + "1" + ")" * 3000 + ";"
    assert syntax.parses(deep, "php") is None
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("(){}[];,=>'\"`/*$a1 \n?:<php") for _ in range(300))
        for language in ("php", "js", "json", "css"):
            syntax.parses("<?php " + text, language)


def test_every_cut_of_a_file_is_judged_like_its_brackets():
    text = "<?php\nfunction f($a) {\n    if ($a) {\n        return array(1, 'x)');\n    }\n    return null;\n}\n"
    assert syntax.parses(text, "php") is None
    assert all(syntax.parses(text[:n], "php") for n in range(8, len(text) - 2))


def test_faults(spark):
    rows = [(1, "a.php", "<?php echo 1;"), (2, "b.PHP", "var a = 1;"), (3, "c.js", "<?php echo 1;"), (4, "d.json", "{"), (5, "e.css", "{{{"), (6, "f.php", None), (7, None, "x"), (8, "g.php", ""), (9, "h.js", "")]
    df = spark.createDataFrame(rows, "file_id long, path string, content string").withColumn("valid", F.lit("clash")).withColumn("slug", F.lit("s"))
    out = syntax.faults(df)
    got = {r.file_id: (r.valid, r.fault, r.parses_as) for r in out.collect()}
    assert got[1] == (True, None, "php") and got[2] == (False, "no_open_tag", "js") and got[3] == (False, "wrong_ending", "php") and got[4] == (False, "damaged", None)
    assert got[5][0] and got[6] == (None, "unread", None) and got[7][0] and got[8] == (False, "no_open_tag", None) and got[9][0]
    accepts = {r.file_id: r.accepts for r in out.collect()}
    assert accepts[1] == ["php"] and accepts[2] == ["js"] and accepts[3] == ["php"] and accepts[4] == [] and accepts[9] == ["js"] and accepts[6] is None
    rates = {r.claimed: r for r in syntax.rates(out).collect()}
    assert rates["php"].files == 4 and rates["php"].zip_errors == 1 and rates["php"].skipped_no_open_tag == 2 and rates["js"].files_with_error == 1
    assert syntax.faults(df.limit(0)).count() == 0


LIB = "/*! Lib */\n" + "\n".join(f"function lib_{i}(a) {{ return a + {i} * helper_{i}(a, 'k{i}'); }}" for i in range(40))


@pytest.mark.parametrize(
    "text,path,expected",
    [
        (LIB.replace("lib_7", "renamed"), "x/y.js", "vendored"), (LIB[: len(LIB) // 2], "x.js", "vendored"), ("<?php\n// Code generated by gen 1.0. DO NOT EDIT.\n$a = 1;", "a.php", "generated"),
        ("<?php\nfwrite( $f, '// Code generated by us. DO NOT EDIT.' );\n$a = 1;\n" * 5, "a.php", None), ("// Auto-generated codes get a prefix, do not edit it here.\nfunction a() {\n  return 1;\n}\n" * 6, "a.js", None),
        ("!function(){" + "".join(f"var a{i}=b{i}(c,{i});if(a{i}>{i}){{d(a{i})}}" for i in range(60)) + "}();", "a.js", "minified"),
        ("<?php\n$x = '" + base64.b64encode(random.Random(1).randbytes(3000)).decode() + "';", "a.php", "data"), ("var p = [" + ",".join(map(str, range(900))) + "];", "a.js", "data"),
        ("GIF89a" + "\x01\x02\x00" * 50, "a.php", "binary"), ("", "a.php", None), ("<?php\n// Silence.\n", "index.php", None), ("<?php\nreturn array(\n" + "".join(f"    'key_{c}' => true,\n" for c in "abcdefghijklmnopqrstuvwxyz") + ");\n", "s.php", None),
        ("<?php\nreturn array(\n" + "".join(f"    'Ns\\\\Cls{i}' => $base . '/src/Cls{i}.php',\n" for i in range(40)) + ");\n", "m.php", "generated"), ("{}", "x/package-lock.json", "lockfile"),
    ],
)
def test_kinds_of_files(text, path, expected):
    assert kind(text, path, Library([LIB]), notices()) == expected


HAND = "<?php\n\nfunction a_thing( $x ) {\n\tif ( $x ) {\n\t\treturn 1;\n\t}\n\treturn 2;\n}\n"


@pytest.mark.parametrize(
    "text,path,expected",
    [
        ("{}", "x/npm-shrinkwrap.json", "lockfile"), ("{}", "x/PACKAGE-LOCK.JSON", "lockfile"), ("{}", "x/package.json", None), (HAND, "vendor/lib/x.php", "vendored"), (HAND, "A\\Node_Modules\\b\\x.js", "vendored"),
        (HAND, "vendors/lib/x.php", None), (HAND, "lib/x.php", None), ("<?php\n/*\nPlugin Name: Own\n*/\n" + HAND[5:], "vendor/x/x.php", None), ("!function(a){a.b=function(c){return c+1}}(window);", "js/app.min.js", "minified"),
        (HAND, "js/app.min.php", None), ("!function(a){a.b=function(c){return c+1}}(window);", "js/app.js", None), ("", "vendor/a.php", None), ("", "a.min.js", None), (None, None, None),
    ],
)
def test_path_rules(text, path, expected):
    assert text is None or kind(text, path, Library([LIB]), notices()) == expected


def test_kinds_do_not_depend_on_the_order_of_files(spark):
    names = ["a/npm-shrinkwrap.json", "a/package.json", "vendor/a/b.php", "src/b.php", "x.min.js", "x.js", "PACKAGE-LOCK.JSON"]
    rows = [(i, n, t) for i, (n, t) in enumerate((n, t) for n in names for t in ("{}", HAND, "var a=1;b(a)"))]
    told = [{r.file_id: r.kind for r in handwritten.kinds(spark.createDataFrame(x, "file_id long, path string, content string").coalesce(1), [LIB]).collect()} for x in (rows, rows[::-1], random.Random(5).sample(rows, len(rows)))]
    assert told[0] == told[1] == told[2] and told[0][0] == "lockfile" and told[0][3] is None


def test_data_rules_hold_at_any_length():
    blob = base64.b64encode(random.Random(1).randbytes(90)).decode().rstrip("=")
    assert kind(f"<?php\n$x = '{blob}';", "a.php", Library([]), notices()) == "data"
    assert kind("var p = [" + ",".join(map(str, range(40))) + "];", "a.js", Library([]), notices()) == "data"


def test_library_share_equals_sets():
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(80)) for _ in range(4)]
    lib = Library(texts)
    probe = texts[2][:150] + " w1 w2 " + texts[2][150:]
    grams = lambda t: [tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)]
    expected = max(sum(g in set(grams(t)) for g in grams(probe)) for t in texts) / len(grams(probe))
    assert lib.share(probe)[0] == pytest.approx(expected)
    assert Library([]).share("a b c d e f")[0] == 0


def test_kinds_on_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a.php", None), (2, None, ""), (3, "b.js", LIB)], "file_id long, path string, content string")
    assert {r.file_id: r.kind for r in handwritten.kinds(df, [LIB]).collect()} == {1: None, 2: None, 3: "vendored"}


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(encode.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(spark, encoding):
    texts = [None, "", " ", "Hello world's  end\n\n x", "naïve 日本語 ​　x \x1c \x85  z", "a" * 3000, "=" * 500 + "xy" * 300, "🙂👍🏽 é", "don't DON'T I'LL 12345 3.14", "<|endoftext|>", "zxqv" * 40, "\t\ttab\r\nline "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    out = encode.encode(df).withColumn("back", encode.decode(F.col("ids"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == encoding.encode_ordinary(r.text or ""), r.text
        assert r.back == (r.text or "")
    assert encode.encode(df.limit(0)).count() == 0


def test_counted(spark, encoding):
    rows = [("a", "some zxqv text"), ("a", "some zxqv text"), ("b", None), (None, "x"), ("c", "pfuiteufel")]
    got = encode.counted(spark.createDataFrame(rows, "source string, text string")).collect()
    n = lambda t: len(encoding.encode_ordinary(t or ""))
    assert sorted(got, key=str) == sorted([(s, n(t)) for s, t in rows], key=str)


def test_long_words_are_cut_where_nothing_merges(spark, encoding):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(6000)), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(3000)), "the" * 700, "ⅷⅷ𝒳" * 100, "zq" * 50 + " zq"]
    got = encode.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).collect()
    assert {r.doc_id: r.ids for r in got} == {i: encoding.encode_ordinary(t) for i, t in enumerate(texts)}


SPAM = ["cheap seo tool best seo tool free seo tool buy seo tool now seo tool " * 4, "\n".join(f"https://x{i}.example/p/{i}" for i in range(12)), "\n".join(f"best plugin ${i}.99 add to cart" for i in range(12)), "free, pro, best, cheap, seo tool, backup plugin, " * 6]
HAM = ["The patch moves the check into another function, and the old one is left as it was. Please tell us whether it works.", "#0 a/b.php(12): f()\n#1 a/c.php(14): g()\n#2 a/d.php(15): h()\nIt fails on every page.", "Thanks!", "", "* Fixed: the search box was empty when the cache was on.\n* Added: a filter for the list of the pages.\n"]


def test_weak_labels():
    label = lambda t: spam.weak_label(dict(zip(spam.FEATURES, spam.features(t))))
    assert [label(t) for t in SPAM] == [1] * 4 and [label(t) for t in HAM] == [0] * 5


def test_scores(spark):
    rows = [(i, "h" if i % 3 else None, (SPAM + HAM)[i % 9] + f" {i}") for i in range(180)] + [(900, "h", None), (900, "h", None)]
    got = spam.score(spark.createDataFrame(rows, "doc_id long, slug string, text string")).collect()
    assert len(got) == 182
    assert all((r.score >= 0.5) == (r.doc_id % 9 < 4 and r.doc_id < 900) for r in got)
    assert spam.score(spark.createDataFrame([(1, "h", "x")], "doc_id long, slug string, text string")).first().score == 0


def test_held_out_pages_agree_with_their_labels(spark):
    rows = [(i, (SPAM + HAM)[i % 9] + f" {i}") for i in range(360)]
    df = spam.featured(spark.createDataFrame(rows, "doc_id long, text string"))
    model = spam.train(df.where("doc_id < 180"))
    from pyspark.ml.functions import array_to_vector

    out = model.transform(df.where("doc_id >= 180").withColumn("features", array_to_vector("f"))).collect()
    assert sum(r.prediction == r.weak for r in out) >= 0.98 * len(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, small, name):
    QUERIES[name](spark, small).count()


@pytest.mark.parametrize("notice,expected", [("自動生成されました", True), ("このファイルは編集しないでください", True), ("自动生成的", True), ("请勿编辑此文件", True), ("generated fileset", False), ("autogenerated by x", True)])
def test_notices_in_scripts_without_blanks(notice, expected):
    assert handwritten.noticed(f"// {notice}", handwritten.notices()) == expected
