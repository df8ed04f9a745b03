"""Hand-written files: the small inputs every engine must get right, and the
corners of each language. Where grammars disagree the test records our rule."""

import pytest

from helpers import corpus, symbols
from srcatlas.operators.declarations import definition_spans, extract_symbols
from srcatlas.operators.structural import find_calls, find_type
from srcatlas.operators.tokens import positioned, tokenize

BASIC = {
    "shelf.rs": ("pub enum Spine {}\npub struct Shelf {}\n\npub fn dust() {}\n",
                 [("Spine", "enum", 1), ("Shelf", "struct", 2), ("dust", "fn", 4)]),
    "lamp.py": ("class Lamp:\n    def glow(self):\n        return 1\n\ndef dim(level):\n    return level\n",
                [("Lamp", "class", 1), ("glow", "fn", 2), ("dim", "fn", 5)]),
    "lamp.swift": ("class Lamp {}\nenum Hue {}\n\nfunc glow() {}\nstruct Bulb {}\n",
                   [("Lamp", "class", 1), ("Hue", "enum", 2), ("glow", "fn", 4), ("Bulb", "struct", 5)]),
    "src/shade.rs": ("pub struct Shade { tint: u8 }\n\npub fn fold(width: &str) -> String { format!(\"<{width}>\") }\n",
                     [("Shade", "struct", 1), ("fold", "fn", 3)]),
}

EDGES = {
    "e.rs": (r'''/* outer /* fn nested() {} */ struct Hidden; */
fn life<'a>(x: &'a str) -> char { '{' }
fn arr(a: [u8; 4]) -> [u8; 2] { [0; 2] }
const fn cf() {}
struct G<const N: usize>;
type F = fn(i32) -> i32;
trait T { type Item; type D: Clone; fn sig(&self) -> u8; fn with(&self) { } }
impl X { const K: u8 = b'"'; type Item = u8; }
let p: *const Foo = x; static mut COUNT: i32 = 0;
let raw = r#"fn no() { " }"#; let c = '"'; fn r#type() {}
fn
late() {}
extern "C" { fn ext(a: i32); }
fn bound<I: Iterator<Item = u8>>(i: I) where I: Copy { fn inner() {} }
mod decl;
pub(crate) enum E { A { x: i32 } }
unsafe trait U {}
macro_rules! m { ($x:ident) => { struct $x; } }
''', [("life", "fn", 2), ("arr", "fn", 3), ("cf", "fn", 4), ("G", "struct", 5), ("F", "type", 6), ("T", "trait", 7),
      ("with", "fn", 7), ("K", "const", 8), ("Item", "type", 8), ("COUNT", "static", 9), ("r#type", "fn", 10),
      ("late", "fn", 12), ("bound", "fn", 14), ("inner", "fn", 14), ("decl", "mod", 15), ("E", "enum", 16),
      ("U", "trait", 17), ("m", "macro", 18)]),
    "e.py": ('''"""def no(): pass
class Never: "quoted" """
x = 'class A:'  # def nope(): pass
@deco
async def one(a, b=lambda: 0): return f"def {a}"
class Two(Base, metaclass=M):
    s = r'\\'
    def three(self): """doc 'x' """; return 1
    class Four: pass
def \\
five(): pass
''', [("one", "fn", 5), ("Two", "class", 6), ("three", "fn", 8), ("Four", "class", 9), ("five", "fn", 11)]),
    "e.js": ('''#!/usr/bin/env node
const f = function named() { return /function no() {"/; };
const t = `class No { ${a ? `function x() {}` : ''} }`;
function* gen() {}
async function run() { if (x) { while (y) {} } }
export default function main() {}
const K = class Inner {};
export default class App extends Base { constructor() {} static async go(a) {} get v() { return 1 } #p() {} *it() {} }
const o = { meth(a) { }, arrow: (x) => { }, prop: function () {} };
foo(function () { }); describe("it", () => {});
let q = a / b; let r = c / d; function last() {}
''', [("run", "fn", 5), ("main", "fn", 6), ("App", "class", 8), ("constructor", "method", 8), ("go", "method", 8),
      ("v", "method", 8), ("it", "method", 8), ("meth", "method", 9), ("last", "fn", 11)]),
    "e.ts": ('''export abstract class Abs { abstract a(): void; b(): string { return ""; } }
declare function ext(a: number): void;
function over(a: string): void;
function over(a: any): void { }
export class Plain<T> extends Base<T> { private m<U>(x: U): Promise<U> { return x as any; } }
interface Shape { area(): number; name: string }
export type Pair<A> = [A, A];
import type { X } from "./x";
const enum Level { Low }
const v = c ? call(x) : { y: 1 };
const g = (a: number): number => { return a; };
''', [("b", "method", 1), ("over", "fn", 4), ("Plain", "class", 5), ("m", "method", 5), ("Shape", "interface", 6),
      ("Pair", "type", 7), ("Level", "enum", 9)]),
    "e.go": ('''package p
type A = B
type (
	One struct { x int }
	Two = Three
	Four func(a int) error
)
func Map[T any](f func(T) T) {}
func (s *Srv[T]) Handle(w Writer) error { h := func(x int) int { return x }; _ = h; return nil }
var s = `func no() {}`
type I interface { Do(x int) }
var r = '"'
func main() { foo(
	a, b)
}
''', [("One", "type", 4), ("Four", "type", 6), ("Map", "fn", 8), ("Handle", "method", 9), ("I", "type", 11),
      ("main", "fn", 13)]),
    "e.c": ('''#define MAKE(n) struct n { int x; }; \\
  int fake(void) { return 0; }
struct fwd;
typedef struct node { struct node *next; } node_t;
static inline int add(int a, int b)
{
  if (a) { return (b); }
  while (a) { }
}
int *ptr(void) { return 0; }
int proto(int a);
enum color { RED };
extern "C" { int inside(void) { return 1; } }
char c = '{'; const char *s = "int no() {";
unsigned long long wide(enum color k) { call(k); return 0; }
''', [("fwd", "struct", 3), ("node", "struct", 4), ("node", "struct", 4), ("add", "fn", 5), ("color", "enum", 12),
      ("inside", "fn", 13), ("wide", "fn", 15), ("color", "enum", 15)]),
    "e.cpp": ('''#include <vector>
template <class T> class Box { public: Box() {} int in() const { return 1; } };
Foo::Foo(int x) : a(x), b{x} { }
Foo::~Foo() { }
bool Foo::operator==(const Foo& o) const { return true; }
int ns_fn(std::vector<int> v) noexcept { return v.size(); }
auto tail(int a) -> int { return a; }
int& ref() { return x; }
namespace a::b { int deep() { return 0; } }
namespace { struct Anon : Base { void m() override { } }; }
class Fwd; friend class Pal;
enum class Mode : int { X }; enum Plain { Y };
auto text = R"(class No { int f() { } })"; int big = 1'000'000;
int lambda() { auto l = [](int q) { return q; }; return l(1); }
''', [("Box", "class", 2), ("Foo::Foo", "fn", 3), ("Foo::~Foo", "fn", 4), ("Foo::operator==", "fn", 5),
      ("ns_fn", "fn", 6), ("tail", "fn", 7), ("deep", "fn", 9), ("Anon", "struct", 10), ("Fwd", "class", 11),
      ("Mode", "enum", 12), ("Plain", "enum", 12), ("lambda", "fn", 14)]),
    "e.swift": ('''/* a /* nested func no() {} */ b */
final class K: Base { class func make() -> K { return K() } class var v = 1; init() {} func m<T>(x: T) throws -> [T] { [] } }
protocol P { func need(); var x: Int { get } }
extension K: P { static func ext() { } }
let s = "func \\(call("x")) {"; let m = """
struct No {}
"""
indirect enum Tree { case leaf }
actor Store { }
typealias Done = () -> Void
public struct Point { }
''', [("K", "class", 2), ("make", "fn", 2), ("m", "fn", 2), ("P", "interface", 3), ("K", "type", 4), ("ext", "fn", 4),
      ("Tree", "enum", 8), ("Store", "class", 9), ("Done", "type", 10), ("Point", "struct", 11)]),
    "e.sh": ('''#!/bin/bash
function one { echo "${x#y}"; }
two() {
  case $1 in
    a) echo "fn() {" ;;
    b|c) three_call ;;
  esac
}
my-func () { :; }
cat <<EOF
hidden() { :; }
EOF
arr=(a b); echo a#b; echo 'q() {'
function four() ( true )
''', [("one", "fn", 2), ("two", "fn", 3), ("my-func", "fn", 9), ("four", "fn", 14)]),
}


@pytest.mark.parametrize("path", list(BASIC))
def test_basic(spark, path):
    text, want = BASIC[path]
    assert symbols(spark, path, text) == want


@pytest.fixture(scope="module")
def edge_rows(spark):
    return extract_symbols(corpus(spark, {path: text for path, (text, _) in EDGES.items()})).collect()


@pytest.mark.parametrize("path", list(EDGES))
def test_edges(edge_rows, path):
    got = [(r.name, r.kind, r.line) for r in edge_rows if r.file == path]
    assert got == EDGES[path][1]


def test_odd_files(spark):
    files = corpus(spark, {
        "empty.py": "", "crlf.py": "def a():\r\n    pass\r\nclass B:\r\n    pass\r\n", "UPPER.PY": "def no(): pass",
        "bad.py": b"def ok(): pass\nx = '\xff\xfe'\n", "blank.rs": "\n \n\t\n", "gone.go": None, "x.txt": "def n():",
    })
    got = [(r.file, r.name, r.kind, r.line) for r in extract_symbols(files).collect()]
    assert got == [("bad.py", "ok", "fn", 1), ("crlf.py", "a", "fn", 1), ("crlf.py", "B", "class", 3)]


def test_long_literal_and_many_tokens(spark):
    text = ('s = "' + "x\\n" * 400_000 + '"\ndef after(): pass\n' + "y = [1, (2, {3: 4})]\n" * 20_000
            + "def end(): pass\n")
    assert symbols(spark, "long.py", text) == [("after", "fn", 2), ("end", "fn", 20_003)]


def test_calls_are_not_definitions(spark):
    files = corpus(spark, {
        "a.rs": "fn helper(n: u8) -> u8 { n + 9 }\npub fn outer() -> u8 { self_check(); helper(3) }\n",
        "b.c": "int helper(int a) { return 1; }\nint *helper2();\nint go(void) { return helper(2) + x->helper(3); }\n",
        "c.ts": "class A { helper(a: number): void { helper(a); this.helper(1); } }\n",
        "d.go": "func helper() {}\nfunc (t T) helper(x int) {}\nfunc go() { helper(); t.helper(1) }\n",
    })

    def at(lang):
        rows = find_calls(files, "helper", lang).collect()
        return [(r.capture, r.text, r.start_line, r.end_line) for r in rows]

    assert at("rust") == [("@fn", "helper", 2, 2), ("@call", "helper(3)", 2, 2)]
    assert at("c") == [("@fn", "helper", 3, 3), ("@call", "helper(2)", 3, 3)]
    assert at("typescript") == [("@fn", "helper", 1, 1), ("@call", "helper(a)", 1, 1)]
    assert at("go") == [("@fn", "helper", 3, 3), ("@call", "helper()", 3, 3)]
    assert find_type(files, "Missing", "rust").count() == 0


def test_unknown_language_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown language"):
        find_calls(corpus(spark, {"a.rs": ""}), "x", "cobol")


def test_more_than_calls_look_like_calls(spark):
    files = corpus(spark, {
        "p.py": "print(1)\nfoo(2)\n", "s.sh": "if true; then\n  foo a\nfi\nfor x in 1; do bar; done\n",
        "j.js": "const f = async (x) => { g(x); };\n", "r.rs": "fn t(f: &dyn Fn(i32)) { g(1); }\n"})

    def names(lang):
        return sorted(r.text for r in find_calls(files, None, lang).where("capture = '@fn'").collect())

    assert names("python") == ["foo", "print"] and names("javascript") == names("rust") == ["g"]
    assert not {"if", "then", "fi", "for", "do", "done"} & set(names("bash"))


def test_no_cap_unless_asked_for(spark):
    files = corpus(spark, {"many.py": "".join(f"def f{i}(): pass\n" for i in range(700))})
    assert extract_symbols(files, "PY").count() == 700 and extract_symbols(files, cap=5).count() == 5


def test_comments_only_shift_lines(spark):
    plain, _ = BASIC["shelf.rs"]
    noisy = "// fn decoy() {}\n" + plain.replace("pub fn", "/* struct No */ pub fn")
    assert symbols(spark, "n.rs", noisy) == [(n, k, line + 1) for n, k, line in symbols(spark, "p.rs", plain)]


def test_macro_bodies_hold_no_items(spark):
    text = """macro_rules! mk { () => { struct Hid; fn hidden() { let x = [1; 2]; } } }
thread_local! { static TL: u8 = 1; }
fn real() { let v = vec![1, 2]; quote! { struct Quoted; fn inq() {} }; struct Local; }
fn not() -> bool { if !(a) { fn inner() {} } !b }
struct After;
"""
    want = [("mk", "macro", 1), ("real", "fn", 3), ("Local", "struct", 3), ("not", "fn", 4), ("inner", "fn", 4), ("After", "struct", 5)]
    assert symbols(spark, "m.rs", text) == want
    spans = definition_spans(corpus(spark, {"m.rs": text}), "rust").collect()
    assert sorted((r.name, r.start_line, r.end_line) for r in spans) == sorted((n, line, line) for n, _, line in want)


def test_rust_item_extent(spark):
    """An item starts at its first modifier, not at an attribute and not at its keyword's line."""
    text = "#[inline] pub fn one() { }\npub(crate)\nfn two() { }\n#[derive(Debug)]\nstruct Three { a: [u8; 4] }\nfn\nfour() { }\n"
    spans = definition_spans(corpus(spark, {"x.rs": text}), "rust").collect()
    got = {r.name: (r.start_line, r.end_line, text[r.start_at:r.end_at]) for r in spans}
    assert got == {"one": (1, 1, "pub fn one() { }"), "two": (2, 3, "pub(crate)\nfn two() { }"),
                   "Three": (5, 5, "struct Three { a: [u8; 4] }"), "four": (6, 7, "fn\nfour() { }")}


def test_arms_of_directives_restart(spark):
    """A bracket that each arm opens is open once behind them; without arms nothing changes."""
    text = "#if A\nif (x) {\n#elif B\nif (y) { (\n#else\n[\n#endif\nz }\nw\n#if C\n{\n#endif\nv\n"
    files = spark.createDataFrame([("a.c", "c", text.encode()), ("b.cc", "cpp", b"#if A\n{\n#endif\n}\nw")], "path string, lang string, content binary")
    at = {(r.file, r.text): (r.paren, r.brace) for r in tokenize(files).where("cls = 'ident'").collect()}
    assert at["a.c", "x"] == (1, 0) and at["a.c", "y"] == (1, 0)
    assert at["a.c", "z"] == (0, 1) and at["a.c", "w"] == (0, 0) and at["a.c", "v"] == (0, 1)
    assert at["b.cc", "w"] == (0, 0)


HOLED = {
    "h.js": "const a = `x ${f(1)} ${g(`in ${h({a: 2})} z`)}`;\nlet b = `\\${no(1)} $ {`; after(1);\n",
    "h.py": "x = f\"{f(1)!r:>{g(2)}} {{no(1)}}\" 'a' rf'''\n{h('q')}'''\nafter(1)\n",
    "h.swift": 'let s = "\\(f(1)) \\(g("in \\(h((2))) z"))"\nlet t = #"\\(no(1))"#\nafter(1)\n',
    "h.sh": 'x="$(f "$(g "b c")" $((1+2))) $(h | sort)" \'$(no)\'\nafter 1\n',
}


@pytest.mark.parametrize("path", list(HOLED))
def test_code_in_strings(spark, path):
    """Calls in holes are found; the pieces of a string are its text, and its brackets close."""
    files = corpus(spark, {path: HOLED[path]})
    lang = files.first().lang
    rows = positioned(files, [lang]).orderBy("pos").collect()
    assert all(HOLED[path][r["at"]:r["until"]] == r["text"] for r in rows)
    assert (rows[-1].paren, rows[-1].brace, rows[-1].level) == (0, 0, 0)
    found = {r.text for r in find_calls(files, None, lang).collect() if r.capture == "@fn"}
    assert found == {"f", "g", "h", "after"} | ({"sort"} if lang == "bash" else set())


def test_unclosed_holes_stay_text(spark):
    """A string whose hole never closes is cut as before, and what follows is found."""
    assert symbols(spark, "u.js", "const a = `${ { `;\nfunction after() {}\n") == [("after", "fn", 2)]
    assert symbols(spark, "u.py", "x = f'{'\ndef after(): pass\n") == [("after", "fn", 2)]
    assert symbols(spark, "u.sh", 'x="$("\nafter() { :; }\n') == [("after", "fn", 2)]


def test_long_strings_with_code(spark):
    """800 kB in one string, and 20,000 holes in one."""
    long = corpus(spark, {"l.js": "const a = `" + "x" * 800_000 + "${f(1)}`;\nconst b = `" + "${g(1)}" * 20_000 + "`;\n"})
    found = find_calls(long, None, "javascript").where("capture = '@fn'").groupBy("text").count().collect()
    assert {(r["text"], r["count"]) for r in found} == {("f", 1), ("g", 20_000)}


def test_comments_nest_deep(spark):
    for path, word in (("n.rs", "fn"), ("n.swift", "func")):
        text = "/*" * 30 + f" don't {word} no() {{}} " + "*/" * 30 + f"\n{word} after() {{}}\n"
        assert symbols(spark, path, text) == [("after", "fn", 2)]
