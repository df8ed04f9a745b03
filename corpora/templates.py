"""File templates ({k} = part key, {n} = part name) and what they declare."""

TEMPLATES = {
    "rust": [
        "// fn decoy_{k}() {}",
        "pub struct T{k} { x: i32 }",
        "pub enum E{k} { A, B }",
        "pub trait R{k} { fn sig_{k}(&self); }",
        "impl R{k} for T{k} {",
        '    fn sig_{k}(&self) { helper_{k}("struct D{k} {"); self.go_{k}(); }',
        "}",
        "const C{k}: i32 = 1;",
        "static S{k}: i32 = 2;",
        "type A{k} = i32;",
        "mod m{k} { pub fn {n}_{k}() {} }",
        "macro_rules! mac{k} { () => {} }",
    ],
    "python": [
        "# def decoy_{k}(): pass",
        "class K{k}:",
        "    def meth_{k}(self):",
        '        return "class D{k}:"',
        "async def {n}_{k}(x):",
        "    return helper_{k}(x)",
    ],
    "javascript": [
        "// function decoy_{k}() {}",
        "export class K{k} {",
        '  meth_{k}(a) { if (a) { return "class D{k} {"; } }',
        "}",
        "function {n}_{k}(x) { return helper_{k}(x); }",
    ],
    "typescript": [
        "/* interface D{k} {} */",
        "export interface I{k} { a: string }",
        "type A{k} = string;",
        "enum E{k} { X }",
        "class K{k} {",
        "  meth_{k}(a: number): number { return a; }",
        "}",
        'function {n}_{k}(x: string): string { return "enum D{k} {"; }',
    ],
    "go": [
        "// func decoy_{k}() {}",
        "package p",
        "type T{k} struct { x int }",
        "type (",
        "  G{k} int",
        ")",
        "func (t T{k}) M{k}() {}",
        'func {n}_{k}() string { return "type D{k} int" }',
    ],
    "c": [
        "/* int decoy_{k}() { } */",
        "struct T{k} { int x; };",
        "enum E{k} { A{k} };",
        "int {n}_{k}(struct T{k} t) {",
        '  if (t.x) { helper_{k}("struct D{k}"); }',
        "  return 0;",
        "}",
    ],
    "cpp": [
        "// class D{k} {};",
        "namespace ns{k} {",
        "class K{k} { void m(); };",
        "struct T{k} { int x; };",
        "enum class E{k} { A };",
        'void K{k}::m() { helper_{k}("struct D{k}"); }',
        "int {n}_{k}(int a) { return a; }",
        "}",
    ],
    "swift": [
        "// func decoy_{k}() {}",
        "struct T{k} {}",
        "class K{k} {}",
        "actor B{k} {}",
        "enum E{k} {}",
        "protocol P{k} {}",
        "typealias A{k} = Int",
        'func {n}_{k}() { print("struct D{k} {") }',
    ],
    "bash": [
        "# decoy_{k}() { :; }",
        "{n}_{k}() {",
        '  echo "fake_{k}() {"',
        "}",
        "function g{k} { :; }",
    ],
}

# (kind, name, line, last line of the whole declaration)
PLANTED = {
    "rust": [
        ("struct", "T{k}", 2, 2), ("enum", "E{k}", 3, 3), ("trait", "R{k}", 4, 4), ("fn", "sig_{k}", 6, 6),
        ("const", "C{k}", 8, 8), ("static", "S{k}", 9, 9), ("type", "A{k}", 10, 10), ("mod", "m{k}", 11, 11),
        ("fn", "{n}_{k}", 11, 11), ("macro", "mac{k}", 12, 12),
    ],
    "python": [("class", "K{k}", 2, 4), ("fn", "meth_{k}", 3, 4), ("fn", "{n}_{k}", 5, 6)],
    "javascript": [("class", "K{k}", 2, 4), ("method", "meth_{k}", 3, 3), ("fn", "{n}_{k}", 5, 5)],
    "typescript": [
        ("interface", "I{k}", 2, 2), ("type", "A{k}", 3, 3), ("enum", "E{k}", 4, 4), ("class", "K{k}", 5, 7),
        ("method", "meth_{k}", 6, 6), ("fn", "{n}_{k}", 8, 8),
    ],
    "go": [("type", "T{k}", 3, 3), ("type", "G{k}", 5, 5), ("method", "M{k}", 7, 7), ("fn", "{n}_{k}", 8, 8)],
    "c": [("struct", "T{k}", 2, 2), ("enum", "E{k}", 3, 3), ("struct", "T{k}", 4, 4), ("fn", "{n}_{k}", 4, 7)],
    "cpp": [
        ("namespace", "ns{k}", 2, 8), ("class", "K{k}", 3, 3), ("struct", "T{k}", 4, 4), ("enum", "E{k}", 5, 5),
        ("fn", "K{k}::m", 6, 6), ("fn", "{n}_{k}", 7, 7),
    ],
    "swift": [
        ("struct", "T{k}", 2, 2), ("class", "K{k}", 3, 3), ("class", "B{k}", 4, 4), ("enum", "E{k}", 5, 5),
        ("interface", "P{k}", 6, 6), ("type", "A{k}", 7, 7), ("fn", "{n}_{k}", 8, 8),
    ],
    "bash": [("fn", "{n}_{k}", 2, 4), ("fn", "g{k}", 5, 5)],
}

LANG_ORDER = sorted(TEMPLATES)

# Every identifier with the part key, outside comments and strings: (name, lines)
MENTIONS = {
    "rust": [
        ("T{k}", [2, 5]), ("E{k}", [3]), ("R{k}", [4, 5]), ("sig_{k}", [4, 6]), ("helper_{k}", [6]), ("go_{k}", [6]),
        ("C{k}", [8]), ("S{k}", [9]), ("A{k}", [10]), ("m{k}", [11]), ("{n}_{k}", [11]), ("mac{k}", [12]),
    ],
    "python": [("K{k}", [2]), ("meth_{k}", [3]), ("{n}_{k}", [5]), ("helper_{k}", [6])],
    "javascript": [("K{k}", [2]), ("meth_{k}", [3]), ("{n}_{k}", [5]), ("helper_{k}", [5])],
    "typescript": [
        ("I{k}", [2]), ("A{k}", [3]), ("E{k}", [4]), ("K{k}", [5]), ("meth_{k}", [6]), ("{n}_{k}", [8]),
    ],
    "go": [("T{k}", [3, 7]), ("G{k}", [5]), ("M{k}", [7]), ("{n}_{k}", [8])],
    "c": [("T{k}", [2, 4]), ("E{k}", [3]), ("A{k}", [3]), ("{n}_{k}", [4]), ("helper_{k}", [5])],
    "cpp": [
        ("ns{k}", [2]), ("K{k}", [3]), ("T{k}", [4]), ("E{k}", [5]), ("K{k}::m", [6]), ("helper_{k}", [6]),
        ("{n}_{k}", [7]),
    ],
    "swift": [
        ("T{k}", [2]), ("K{k}", [3]), ("B{k}", [4]), ("E{k}", [5]), ("P{k}", [6]), ("A{k}", [7]), ("{n}_{k}", [8]),
    ],
    "bash": [("{n}_{k}", [2]), ("g{k}", [5])],
}
# Calls, and what only looks like them: patterns, attributes, variants, signatures, initialisers, macro arguments
CALL_TEMPLATES = {
    "rust": [
        "#[derive(Debug)]", "#[cfg(test)]", "enum E{k} { A(i32), B(Vec<u8>) }", "fn f{k}(o: Option<i32>) -> Result<i32, E{k}> {",
        "    match o { Some(x) => one_{k}(x), None => two_{k}(), }", "    if let Some(Ok(y)) = three_{k}(o) { four_{k}(y); }",
        "    match g{k}(1) { Some(P(z)) | Q(z) if five_{k}(z) => six_{k}(z), _ => {} }", '    println!("{}", in_macro(1));',
        "    let v = Some(seven_{k}(1));", "}",
    ],
    "python": [
        "class K{k}(Base):", "    def m(self):", "        match g_{k}(1):", "            case Point(x) | Line(x) if ok_{k}(x):", "                h_{k}(x)",
        "        return self.a[0].b(c_{k}(2)).d()",
    ],
    "go": [
        "package p", "type I{k} interface { Meth(a int) }", "var (", "  x = f_{k}(1)", ")", "func (t T) M{k}() { g_{k}(2); t.h(3) }",
    ],
    "c": ["int f{k}(int a);", "#define M(x) h(x)", "int main(void) { g_{k}(1); return h_{k}(2); }"],
    "cpp": ["C{k}::C{k}(int a) : x(1), y(h_{k}(a)) { f_{k}(a); }", "int g{k}(int a) { return a ? k_{k}(a) : l_{k}(1); }"],
    "swift": [
        "@available(iOS 13, *)", "enum E{k} { case k(Int); case l }", "class A{k} { init(x: Int) { super.init(x) }", "  func f() { g_{k}(1)",
        "    run_{k} { h_{k}(2) }", "    if x { self.list.map { $0 } }", "  } }",
    ],
    "typescript": [
        "interface I{k} { m(a: number): void }", "class K{k} { n(a: number): number { return e_{k}<T>(1) + this.q.r(2); } }",
        "if (a_{k}(1) && b < c) { d_{k}(2); }",
    ],
    "javascript": ["class K{k} { meth(a) { if (a) { return b_{k}(a); } } }", "const z = async (x) => f_{k}(x).then(y => g_{k}(y));"],
    "bash": [
        "A=1 cmd_{k} one", "case $x in", "  a) arm_{k} two ;;", "  b|c) other_{k} ;;", "esac", "f{k}() { inner_{k}; }", "plain_{k} && next_{k} | last_{k}",
    ],
}

# Arms of directives that each open a brace, inside one another too, and functions behind them
BRANCH_TEMPLATES = {lang: [
    "#ifdef A{k}", "int f_{k}(int a) {", "#else", "int f_{k}(long a) {", "#endif", "  g(a);", "}", "int after_{k}(int x) { return x; }", "#if X", "#  if Y",
    "int h_{k}(void) {", "#  elif Z", "int i_{k}(int z) {", "#  else", "int j_{k}(int z) { if (z) {", "#  endif", "  k();", "}", "#else", "struct S_{k} { int a;",
    "# ifdef Q", "}; int q_{k}(int q) { return q; }", "# else", "}; int r_{k}(int q) { return q; }", "# endif", "int last_of_else_{k}(int w) { return 1; }", "#endif",
    "int end_{k}(int y) { return y; }",
] for lang in ("c", "cpp")}

BRANCH_SYMBOLS = [
    ("f_{k}", "fn", 2), ("f_{k}", "fn", 4), ("after_{k}", "fn", 8), ("h_{k}", "fn", 11), ("i_{k}", "fn", 13), ("j_{k}", "fn", 15), ("S_{k}", "struct", 20),
    ("q_{k}", "fn", 22), ("r_{k}", "fn", 24), ("last_of_else_{k}", "fn", 26), ("end_{k}", "fn", 28),
]

# (call, line); a name ends where its arguments start
CALLS = {
    "rust": [
        ("one_{k}(x)", 5), ("two_{k}()", 5), ("three_{k}(o)", 6), ("four_{k}(y)", 6), ("g{k}(1)", 7), ("five_{k}(z)", 7), ("six_{k}(z)", 7),
        ("Some(seven_{k}(1))", 9), ("seven_{k}(1)", 9),
    ],
    "python": [("g_{k}(1)", 3), ("ok_{k}(x)", 4), ("h_{k}(x)", 5), ("c_{k}(2)", 6)],
    "go": [("f_{k}(1)", 4), ("g_{k}(2)", 6)],
    "c": [("g_{k}(1)", 3), ("h_{k}(2)", 3)],
    "cpp": [("h_{k}(a)", 1), ("f_{k}(a)", 1), ("k_{k}(a)", 2), ("l_{k}(1)", 2)],
    "swift": [("g_{k}(1)", 4), ("run_{k} { h_{k}(2) }", 5), ("h_{k}(2)", 5)],
    "typescript": [("e_{k}<T>(1)", 2), ("a_{k}(1)", 3), ("d_{k}(2)", 3)],
    "javascript": [("b_{k}(a)", 1), ("f_{k}(x)", 2), ("g_{k}(y)", 2)],
    "bash": [("cmd_{k}", 1), ("arm_{k}", 3), ("other_{k}", 4), ("inner_{k}", 6), ("plain_{k}", 7), ("next_{k}", 7), ("last_{k}", 7)],
}

# Identifiers of the templates that end in digits of their own.
FIXED_NAMES = ["i32"]

# Declarations and calls as nodes: (type, name, line, last line, type of the node around, its field)
NESTED = {
    "rust": [
        ("struct", "T{k}", 2, 2, "file", None), ("enum", "E{k}", 3, 3, "file", None), ("trait", "R{k}", 4, 4, "file", None),
        ("fn", "sig_{k}", 6, 6, "braces", None), ("call", "helper_{k}", 6, 6, "braces", "body"), ("call", "go_{k}", 6, 6, "braces", "body"),
        ("mod", "m{k}", 11, 11, "file", None), ("fn", "{n}_{k}", 11, 11, "braces", "body"),
    ],
    "javascript": [
        ("class", "K{k}", 2, 4, "file", None), ("method", "meth_{k}", 3, 3, "braces", "body"), ("fn", "{n}_{k}", 5, 5, "file", None),
        ("call", "helper_{k}", 5, 5, "braces", "body"),
    ],
    "go": [("method", "M{k}", 7, 7, "file", None), ("fn", "{n}_{k}", 8, 8, "file", None)],
}

# (capture, text, line, line): functions and the calls in their bodies, and functions without any
CODE_MATCHES = {
    "rust": [
        ("@fn", "sig_{k}", 6, 6), ("@callee", "helper_{k}", 6, 6), ("@fn", "sig_{k}", 6, 6), ("@callee", "go_{k}", 6, 6),
        ("@without", "{n}_{k}", 11, 11),
    ],
    "javascript": [("@fn", "{n}_{k}", 5, 5), ("@callee", "helper_{k}", 5, 5)],
    "go": [("@without", "{n}_{k}", 8, 8)],
}

# Calls in the holes of strings, also strings inside those, and texts that only look like holes
STRING_TEMPLATES = {
    "bash": [
        'x="$(one_{k} a "$(two_{k} "b c")" $((1 + 2)))"', """echo '$(no_{k})' "\\$(no_{k})" # $(no_{k})""", 'y="a $(',
        "  three_{k} | four_{k}", ') b"', 'after_{k}() { echo "n $(five_{k} "${x}")"; }',
    ],
    "javascript": [
        "const a = `x ${f_{k}(1)} y ${g_{k}(`in ${h_{k}({a: k_{k}(2)})} z`)}${m_{k}(3)}`;", "const b = `\\${no_{k}(1)} $no_{k}(2) {no_{k}(3)}`;",
        "function after_{k}(x) { return `function D{k}() {", "${x.map(y => `${y ? `<${p_{k}(y)}>` : ``}`)} }`; }",
    ],
    "python": [
        """x = f"a {f_{k}(1)!r:>{w_{k}(2)}} {{no_{k}(3)}}" + rf'{g_{k}("s")}{h_{k}(4)}'""", "y = f'''", "{i_{k}(5)} '", '{j_{k}(f"{m_{k}(6)}")}',
        "def D{k}(): '''", """z = '{no_{k}(7)}' f"\\N{DASH}{q_{k}(8)}\"""", "def after_{k}(x): return x",
    ],
    "swift": [
        'let s = "x \\(f_{k}(1)) y \\(g_{k}("in \\(h_{k}((2))) z")) (no_{k}(1))"', 'let t = """', " \\(m_{k}(3)) func D{k}() {}", '"""',
        'let u = #"\\(no_{k}(4))"#', "func after_{k}() {}",
    ],
}
STRING_TEMPLATES["typescript"] = STRING_TEMPLATES["javascript"]

STRING_CALLS = {
    "bash": [("one_{k}", 1), ("two_{k}", 1), ("echo", 2), ("three_{k}", 4), ("four_{k}", 4), ("echo", 6), ("five_{k}", 6)],
    "javascript": [
        ("f_{k}(1)", 1), ("g_{k}(`in ${h_{k}({a: k_{k}(2)})} z`)", 1), ("h_{k}({a: k_{k}(2)})", 1), ("k_{k}(2)", 1), ("m_{k}(3)", 1), ("p_{k}(y)", 4),
    ],
    "python": [
        ("f_{k}(1)", 1), ("w_{k}(2)", 1), ('g_{k}("s")', 1), ("h_{k}(4)", 1), ("i_{k}(5)", 3), ('j_{k}(f"{m_{k}(6)}")', 4), ("m_{k}(6)", 4), ("q_{k}(8)", 6),
    ],
    "swift": [("f_{k}(1)", 1), ('g_{k}("in \\(h_{k}((2))) z")', 1), ("h_{k}((2))", 1), ("m_{k}(3)", 3)],
}
STRING_CALLS["typescript"] = STRING_CALLS["javascript"]
STRING_SYMBOLS = {
    "bash": [("after_{k}", "fn", 6)], "javascript": [("after_{k}", "fn", 3)], "python": [("after_{k}", "fn", 7)], "swift": [("after_{k}", "fn", 6)],
    "typescript": [("after_{k}", "fn", 3)],
}

# Comments 20 deep, with quotes that open no string
COMMENT_TEMPLATES = {
    lang: ["/* " * 20 + word + " no_{k}() {} don't \"", " */" * 19 + " " + word + " no_{k}() {} */", word + " after_{k}() {}"]
    for lang, word in (("rust", "fn"), ("swift", "func"))
}
COMMENT_SYMBOLS = [("after_{k}", "fn", 3)]

# Every token of three templates, by line; the class stands before the text
TOKENS = {
    "python": [
        ["comment # def decoy_{k}(): pass"], ["ident class", "ident K{k}", "punct :"],
        ["ident def", "ident meth_{k}", "punct (", "ident self", "punct )", "punct :"], ["ident return", 'string "class D{k}:"'],
        ["ident async", "ident def", "ident {n}_{k}", "punct (", "ident x", "punct )", "punct :"],
        ["ident return", "ident helper_{k}", "punct (", "ident x", "punct )"],
    ],
    "javascript": [
        ["comment // function decoy_{k}() {}"], ["ident export", "ident class", "ident K{k}", "punct {"],
        ["ident meth_{k}", "punct (", "ident a", "punct )", "punct {", "ident if", "punct (", "ident a", "punct )", "punct {", "ident return",
         'string "class D{k} {"', "punct ;", "punct }", "punct }"],
        ["punct }"],
        ["ident function", "ident {n}_{k}", "punct (", "ident x", "punct )", "punct {", "ident return", "ident helper_{k}", "punct (", "ident x",
         "punct )", "punct ;", "punct }"],
    ],
    "go": [
        ["comment // func decoy_{k}() {}"], ["ident package", "ident p"], ["ident type", "ident T{k}", "ident struct", "punct {", "ident x", "ident int", "punct }"],
        ["ident type", "punct ("], ["ident G{k}", "ident int"], ["punct )"],
        ["ident func", "punct (", "ident t", "ident T{k}", "punct )", "ident M{k}", "punct (", "punct )", "punct {", "punct }"],
        ["ident func", "ident {n}_{k}", "punct (", "punct )", "ident string", "punct {", "ident return", 'string "type D{k} int"', "punct }"],
    ],
}
