"""Text functions on fixtures: expected values are written out by hand, case by case."""

from pyspark.sql import functions as F

from corpusrisk.functions import text as tx

CASES = [
    'int a = 1; // in "string"\nb++;',
    "/* a\n comment */ x = 'q'; y = '\"';",
    'puts("esc \\" quote"); /* unclosed',
    "p->q == 0x1F && r != 3abc || a3 >= b << 2 #define X",
    "été café_1 ... ∑ 42",
    "",
    "\"\" '' /**/ //",
    "a/*x*/b//y\nc \"//not\" '/*no*/'",
]


def _col(spark, fn, cases=CASES):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn("s")).collect()]


# tokens separated by one space; a case without tokens is the empty string
RAW = [
    'int a = 1 ; / / in " string " b + + ;',
    "/ * a comment * / x = ' q ' ; y = ' \" ' ;",
    'puts ( " esc \\ " quote " ) ; / * unclosed',
    "p - > q = = 0x1F & & r ! = 3abc | | a3 > = b < < 2 # define X",
    "été café_1 . . . ∑ 42",
    "",
    "\" \" ' ' / * * / / /",
    "a / * x * / b / / y c \" / / not \" ' / * no * / '",
]
OPERATORS = [
    'int a = 1 ; / / in " string " b ++ ;',
    "/ * a comment * / x = ' q ' ; y = ' \" ' ;",
    'puts ( " esc \\ " quote " ) ; / * unclosed',
    "p -> q == 0x1F && r != 3abc || a3 >= b << 2 #define X",
    "été café_1 . . . ∑ 42",
    "",
    "\" \" ' ' / * * / / /",
    "a / * x * / b / / y c \" / / not \" ' / * no * / '",
]


def test_tokenise(spark):
    assert [" ".join(t) for t in _col(spark, tx.tokenise_raw)] == RAW
    numbers = {0: "1", 3: "0x1F 3abc 2", 4: "42"}  # tokens that start like a number become one mark
    expect = [[("<NUM>" if t in numbers.get(i, "").split() else t) for t in r.split()] for i, r in enumerate(RAW)]
    assert _col(spark, tx.tokenise) == expect


def test_tokenise_ops(spark):
    assert [" ".join(t) for t in _col(spark, tx.tokenise_ops)] == OPERATORS


def test_tokens_hold_all_visible_text(spark):
    squeeze = lambda t: "".join(t.split())
    for fn in (tx.tokenise_raw, tx.tokenise_ops):
        assert ["".join(t) for t in _col(spark, fn)] == [squeeze(c) for c in CASES]


def test_strip_comments_exact(spark):
    assert _col(spark, tx.strip_comments) == [
        "int a = 1;  \nb++;",
        "  x = 'q'; y = '\"';",
        'puts("esc \\" quote"); /* unclosed',  # an open comment stays
        "p->q == 0x1F && r != 3abc || a3 >= b << 2 #define X",
        "été café_1 ... ∑ 42",
        "",
        "\"\" ''    ",
        "a b \nc \"//not\" '/*no*/'",
    ]


def test_replace_strings(spark):
    mark = f" {tx.STRING_PLACEHOLDER} "
    changed = {0: f"int a = 1; // in {mark}\nb++;", 2: f'puts({mark} quote"); /* unclosed', 6: f"{mark} '' /**/ //", 7: f"a/*x*/b//y\nc {mark} '/*no*/'"}
    assert _col(spark, tx.replace_strings) == [changed.get(i, c) for i, c in enumerate(CASES)]


def test_denoise(spark):
    assert _col(spark, tx.denoise) == [
        "int a = <NUM> ; b ++ ;",
        "x = ' q ' ; y = ' \" ' ;",
        'puts ( <STR> quote " ) ; / * unclosed',
        "p -> q == <NUM> && r != <NUM> || a3 >= b << <NUM> #define X",
        "été café_1 . . . ∑ <NUM>",
        "",
        "<STR> ' '",
        "a b c <STR> ' / * no * / '",
    ]


def test_long_literal_and_comment_do_not_overflow(spark):
    literal = '"' + "a" * 100_000 + '"'
    escaped = "'" + "\\'" * 50_000 + "'"
    big = [f"x = {literal}; /*{'*' * 1000}{'b' * 100_000}*/ y", escaped]
    assert _col(spark, tx.strip_comments, big) == [f"x = {literal};   y", escaped]


def test_count_tokens(spark):
    expect = ["int in string", "comment", "puts esc quote unclosed", "0x1f 3abc a3 define", "été café_1 42", "", "", "not no"]
    assert _col(spark, tx.count_tokens) == [e.split() for e in expect]


def test_find_desc(spark):
    texts = [
        "Buffer overflow in the foo_bar function in net/ipv4/tcp.c and fs/x.c allows",
        "The baz  implementation in drivers/a.cpp; /abs.c a.c.c x.cc",
        "use-after-free in the init_one function in b.c",
        "nothing here",
    ]
    files = [["net/ipv4/tcp.c", "fs/x.c"], ["abs.c", "a.c", "c"], ["b.c"], []]
    found = _col(spark, tx.find_desc_files, texts)
    assert found[0] == files[0] and found[2:] == files[2:]
    assert "drivers/a.cpp" not in found[1] and "x.cc" not in found[1] and "abs.c" in [f.lstrip("/") for f in found[1]]
    assert _col(spark, tx.find_desc_functions, texts) == [["foo_bar"], ["baz"], ["init_one"], []]


def test_fix_commit_hash(spark):
    urls = {
        "https://github.com/torvalds/linux/commit/0123abcd": "0123abcd",
        "http://git.kernel.org/?p=linux/kernel/git/torvalds/linux-2.6.git;a=commit;h=abc123": "abc123",
        "https://example.com/nothing": None,
    }
    assert _col(spark, tx.fix_commit_hash, list(urls)) == list(urls.values())
    (by_id,) = _col(spark, tx.fix_commit_hash, ["http://git.kernel.org/cgit/linux/kernel/git/torvalds/linux.git/commit/?id=deadbeef"])
    assert by_id != "deadbeef"  # the ?id= form does not yield the hash


def test_attr_name(spark):
    df = spark.createDataFrame([("a-b.c", 3), ("é_x", 0)], "t string, i int")
    assert [r[0] for r in df.select(tx.attr_name("t", "i")).collect()] == ["feat_a_b_c_3", "feat_é_x_0"]


def test_replace_strings_escape_option(spark):
    cases = ['a "x\\"y" b', '"p" "q"']
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    plain = [r[0] for r in df.select(tx.replace_strings("s")).collect()]
    esc = [r[0] for r in df.select(tx.replace_strings("s", c_escapes=True)).collect()]
    ph = f" {tx.STRING_PLACEHOLDER} "
    assert plain[0] == f"a {ph}y\" b" and esc[0] == f"a {ph} b"
    assert plain[1] == esc[1] == f"{ph} {ph}"


def test_find_all_query_on_prepared_documents(spark, tmp):
    """The registered query over a table that holds file names and function phrases."""
    import __spark_entry__ as E

    rows = [(1, "see fs/ext4/inode.c and mm/slab.c: the do_free function in it"), (2, "no match"), (3, "the init  implementation in x; y/z.c")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    got = {r["doc_id"]: (r["files"], r["functions"]) for r in E.queries()["fn_find_all"](spark, tmp).collect()}
    assert got == {1: ("fs/ext4/inode.c,mm/slab.c", "do_free"), 2: ("", ""), 3: ("y/z.c", "init")}
