"""Pieces of code, with the scopes and the uses of each, from which the catalogue's queries on parsing build a file for every document.

A piece is (text, scopes as (type, name, first line, last line, depth), names that it uses and does not define). Names of different pieces differ.
"""

from __future__ import annotations

Case = tuple[str, list[tuple[str, str, int, int, int]], list[str]]
#: What comes before the pieces of a language.
HEADS = {"php": "<?php\n", "go": "package main\n"}
CASES: dict[str, list[Case]] = {
    "javascript": [
        ("class Ja { get jx() { return ja1 } static async *jg() { yield ja2(1) } #jp() {} jy = (q) => q + ja3; }\n", [("class", "Ja", 1, 1, 1), ("method", "jx", 1, 1, 2), ("method", "jg", 1, 1, 2), ("method", "#jp", 1, 1, 2), ("arrow_function", "<anonymous>", 1, 1, 2)], ["ja1", "ja2", "ja3"]),
        ("export default function () {\n  return jb1;\n}\n", [("function", "<anonymous>", 1, 3, 1)], ["jb1"]),
        ("jc1({ m() { jc2() }, k: async (x) => { jc3(x) }, 'a b'() {} });\n", [("method", "m", 1, 1, 1), ("arrow_function", "<anonymous>", 1, 1, 1), ("method", "'a b'", 1, 1, 1)], ["jc1", "jc2", "jc3"]),
        ("function jd(p) {\n  const s = `class { ${jd1(`}${p}{`)} function x() {`;\n  return s.match(/[}/\"'`]+/) / jd2;\n}\n", [("function", "jd", 1, 4, 1)], ["jd1", "jd2"]),
        ("const je = (a, b) => (\n  je1(a) || b\n);\n", [("arrow_function", "je", 1, 3, 1)], ["je1"]),
        ("// function no() {\n/* class No { */\nfunction* jf() { yield 1; }\nasync function jf2(u) { await u }\n", [("generator", "jf", 3, 3, 1), ("function", "jf2", 4, 4, 1)], []),
        ("const jh = function (n) {\n  if (n) { return jh1[n] }\n}\n", [("function", "jh", 1, 3, 1)], ["jh1"]),
        ("function Ji(o) {\n  return <Jbox a={o} b=\"}\">it's {ji1} <jib>}</jib> don't</Jbox>;\n}\n", [("function", "Ji", 1, 3, 1)], ["Jbox", "jib", "ji1"]),
        ("if (jj1) /}/.exec(jj2);\njj3.then(function () { jj4() }, (w, z) => {\n  w(z)\n})\n", [("function", "<anonymous>", 2, 2, 1), ("arrow_function", "<anonymous>", 2, 4, 1)], ["jj1", "jj2", "jj3", "jj4"]),
        ("class Jk extends Jbase {\n  constructor(r) { super(r) }\n  static { jk1() }\n  [jk2]() { return { jk3: 1 } }\n}\n", [("class", "Jk", 1, 5, 1), ("method", "constructor", 2, 2, 2), ("method", "[jk2]", 4, 4, 2)], ["Jbase", "jk1", "jk2"]),
        ("let jl = 1, jl2 = jl3\nvar jl4 = { jl5: jl6, if: 2 }\njl.x = jl7\n", [], ["jl3", "jl6", "jl7"]),
        ("const jm = jm1(() => {\n  jm2()\n});\n", [], ["jm1", "jm2"]),
    ],
    "typescript": [
        ("class Ta<T> extends Tb<T> implements Ti {\n  private x: Map<string, T> = ta1();\n  g = (y: number): string => { return ta2(y) };\n  static of<U>(u: U): Ta<U> { return ta3<U>(u as any) }\n}\n", [("class", "Ta", 1, 5, 1), ("arrow_function", "<anonymous>", 3, 3, 2), ("method", "of", 4, 4, 2)], ["Tb", "ta1", "ta2", "ta3"]),
        ("const tc = <T,>(x: T) => {\n  return tc1(x);\n};\n", [("arrow_function", "tc", 1, 3, 1)], ["tc1"]),
        ("namespace Td.In {\n  export function td1(v: number): v is string { return td2(v) }\n}\n", [("namespace", "Td.In", 1, 3, 1), ("function", "td1", 2, 2, 2)], ["td2"]),
        ("abstract class Te {\n  abstract a(): void;\n  b(c?: Foo): void { te1(c) }\n}\n", [("method", "b", 3, 3, 1)], ["te1"]),
        ("interface Tf extends Tf0 { m(): void; p: { q: number } }\ntype Tf2 = { a: Tf3; b(): void } | null;\n", [], []),
        ("function tg(a: string): void;\nfunction tg(a: any): a is tg9 {\n  return tg1(a) satisfies Tx;\n}\n", [("function", "tg", 2, 4, 1)], ["tg1"]),
        ("export class Th {\n  constructor(private th1: Foo, readonly th2?: Bar) { this.go(th1) }\n  private async load<K>(k: K): Promise<void> {\n    await th3<K>(k);\n  }\n}\n", [("class", "Th", 1, 6, 1), ("method", "constructor", 2, 2, 2), ("method", "load", 3, 5, 2)], ["th3"]),
        ("const tj: Array<string> = [], tj2 = tj3 < tj4, tj5 = tj6 > (1);\n", [], ["tj3", "tj4", "tj6"]),
        ("declare module 'tk' {\n  export function tk1(): void;\n}\nlet tk2: () => void = tk3;\n", [], ["tk3", "tk1"]),
        ("tl1(async (e: Event): Promise<number> => {\n  tl2(`${e} {`);\n  return 1\n});\n", [("arrow_function", "<anonymous>", 1, 4, 1)], ["tl1", "tl2"]),
        ("class Tm { @Tdec() a: string; @Tout() b = new Temit<Tq>(); get c(): Td1 { return tm1 } }\n", [("class", "Tm", 1, 1, 1), ("method", "c", 1, 1, 2)], ["Temit", "tm1"]),
    ],
    "java": [
        ("class Va {\n    String s = \"\"\"\n      class Fake { \"quoted\"\n      \"\"\";\n    int n() { return va1; }\n}\n", [("class", "Va", 1, 6, 1), ("method", "n", 5, 5, 2)], ["va1"]),
        ("record Vb(int a, String b) {\n    Vb { vb1(a); }\n    static Vb of(int x) { return new Vb(x, null); }\n}\n", [("method", "of", 3, 3, 1)], ["Vb", "vb1"]),
        ("enum Vc {\n    RED(1) { void g() { vc1(); } },\n    BLUE;\n    Vc(int v) { this.v = v; }\n}\n", [("enum", "Vc", 1, 5, 1), ("method", "g", 2, 2, 2), ("constructor", "Vc", 4, 4, 2)], ["vc1"]),
        ("public final class Vd<T extends Comparable<T>> extends Vbase implements Vi {\n    private final List<Map<String, Foo>> f = new ArrayList<>();\n    @Override @Ann(a = 1, b = {1, 2})\n    public <R> List<R> go(Map<String, List<R>> in, int... n) throws E, F {\n        in.forEach((k, v) -> { vd1(k); });\n        Runnable r = () -> vd2();\n        return (List<R>) vd3(f);\n    }\n}\n", [("class", "Vd", 1, 9, 1), ("method", "go", 3, 8, 2), ("lambda", "<lambda>", 5, 5, 3), ("lambda", "<lambda>", 6, 6, 3)], ["vd1", "vd2", "vd3"]),
        ("interface Ve {\n    void draw();\n    default int n(int k) { return switch (k) { case 1 -> ve1; default -> 0; }; }\n}\n", [("interface", "Ve", 1, 4, 1), ("method", "draw", 2, 2, 2), ("method", "n", 3, 3, 2)], ["ve1"]),
        ("class Vf {\n    Object o = new Object() { public String toString() { return vf1.go(); } };\n    static { vf2(); }\n}\n", [("class", "Vf", 1, 4, 1), ("method", "toString", 2, 2, 2)], ["vf1", "vf2"]),
        ("// class No {\n@interface Vg { String value() default \"}\"; }\n", [("method", "value", 2, 2, 1)], []),
        ("class Vh {\n    Vh(int n) { this.n = n; }\n    abstract void nobody(String q);\n    class In { char c() { return '}'; } }\n}\n", [("class", "Vh", 1, 5, 1), ("constructor", "Vh", 2, 2, 2), ("method", "nobody", 3, 3, 2), ("class", "In", 4, 4, 2), ("method", "c", 4, 4, 3)], []),
        ("class Vj {\n    void run() throws X {\n        try (Res r = vj1()) { vj2.stream().map(Vj3::new); }\n        catch (A | B e) { throw e; }\n        if (vj5 < vj6 && vj7 > vj8) { int x = (int) vj4, y = 2; }\n    }\n}\n", [("class", "Vj", 1, 7, 1), ("method", "run", 2, 6, 2)], ["vj1", "vj2", "Vj3", "vj5", "vj6", "vj7", "vj8", "vj4"]),
    ],
    "go": [
        ("type Ga func(int) string\n", [], []),
        ("func (s *Gb) Run(ctx context.Context, a int) (map[string]interface{}, error) {\n\tv, err := gb1.New(ctx, `raw { }`)\n\treturn v, err\n}\n", [("method", "Run", 1, 4, 1)], ["gb1"]),
        ("func gc(xs []int) {\n\tfor i, q := range xs {\n\t\tgo func(n int) { gc1(n, q) }(i)\n\t}\n}\n", [("function", "gc", 1, 5, 1), ("function", "<anonymous>", 3, 3, 2)], ["gc1"]),
        ("func Gd[T any, U comparable](x T) U {\n\tvar y U = gd1(x)\n\treturn y\n}\n", [("function", "Gd", 1, 4, 1)], ["gd1"]),
        ("type Ge struct {\n\tA int `json:\"}\"`\n\tB func(int) error\n}\n", [], []),
        ("func gf() *pkg.T {\n\tp := Point{gf1}\n\tz := []pkg.T{{1}, {2}}\n\tif x := gf2(p); x != nil { return &z[0] }\n\treturn nil\n}\n", [("function", "gf", 1, 6, 1)], ["gf1", "gf2"]),
        ("var gg = func(a, b int) int {\n\treturn gg1['}'] + a\n}\n", [("function", "<anonymous>", 1, 3, 1)], ["gg1", "b"]),
        ("/* func no() { */\nfunc gh(w http.ResponseWriter, r *http.Request) { w.Write(gh1) }\n", [("function", "gh", 2, 2, 1)], ["gh1"]),
        ("type Gi interface {\n\tDo(x int) error\n}\n\nvar (\n\tgi1 = gi2\n\tgi3 Gi\n)\n", [], ["gi2"]),
        ("func gj(v any) {\n\tswitch t := v.(type) {\n\tcase int:\n\t\tgj1(t)\n\t}\n\tdefer func() { gj2() }()\n}\n", [("function", "gj", 1, 7, 1), ("function", "<anonymous>", 6, 6, 2)], ["gj1", "gj2", "int"]),
    ],
    "php": [
        ("class Pa { function f() { return new Pa1; } }\ninterface Pi { function g(); }\n", [("class", "Pa", 1, 1, 1), ("method", "f", 1, 1, 2), ("interface", "Pi", 2, 2, 1), ("method", "g", 2, 2, 2)], ["Pa1"]),
        ("$s = <<<EOT\nclass Fake { function z() {}\nEOT;\nfunction pb(&$a) { return pb1($a->name()->b); }\n", [("function", "pb", 4, 4, 1)], ["pb1"]),
        ("#[Pattr(1)]\nfinal class Pc extends Pbase implements Px {\n    use Ptr;\n    public function __construct(private readonly ?Foo $foo, Bar|Baz $b = Pc1::Y) {}\n    abstract protected function q(): ?Ret;\n}\n", [("class", "Pc", 1, 6, 1), ("method", "__construct", 4, 4, 2), ("method", "q", 5, 5, 2)], ["Pattr", "Ptr", "Pc1", "Y"]),
        ("$pd = fn(int $a): int => $a + pd1($a);\n$pd2 = function () use ($pd): Foo { return Pd3::find(1); };\n", [("arrow_function", "<anonymous>", 1, 1, 1), ("closure", "<anonymous>", 2, 2, 1)], ["pd1", "Pd3"]),
        ("trait Pe {\n    private static function m() { try { pe1(); } catch (PeX $e) { } }\n}\n", [("trait", "Pe", 1, 3, 1), ("method", "m", 2, 2, 2)], ["pe1"]),
        ("enum Pf: string {\n    case A = 'a';\n    public function label(): string { return match($this) { self::A => pf1('}') }; }\n}\n", [("method", "label", 3, 3, 1)], ["A", "Pf", "pf1", "self"]),
        ("?>\n<p>function no() { it's</p>\n<?php function pg() { return \"}\" . pg1; } // class X {\n", [("function", "pg", 3, 3, 1)], ["pg1"]),
        ("if (ph1) : ph2(); endif;\n$o = new class extends Ph3 { public function n() { return 1; } };\n", [("method", "n", 2, 2, 1)], ["ph1", "ph2"]),
    ],
    "ruby": [
        ("class Ra::In < Rbase\n  def x = 1\n  def y(a, b = 2) = a + ra1\nend\n", [("class", "Ra::In", 1, 4, 1), ("method", "x", 2, 2, 2), ("method", "y", 3, 3, 2)], ["Ra", "In", "Rbase", "ra1"]),
        ("def rb(q)\n  text = <<~SQL + rb1(<<-B)\n    class Q\n      def no; end\n  SQL\n    end\n  B\n  text\nend\n", [("method", "rb", 1, 9, 1)], ["rb1"]),
        ("module Rc\n  class << self\n    def inner(*a, k: 1, &blk); rc1 if a; end\n  end\n  private def pm() ; end\nend\n", [("module", "Rc", 1, 6, 1), ("method", "inner", 3, 3, 2), ("method", "pm", 5, 5, 2)], ["rc1", "private"]),
        ("rd1.each { |i| rd2(i) }\nrd3 do |w| w end\n", [("block", "<block>", 1, 1, 1), ("block", "<block>", 2, 2, 1)], ["rd1", "rd2", "rd3"]),
        ("f = ->(z) { z + re1 }\nre2(f) unless %w[class def end].map(&:to_s)\n", [("lambda", "<lambda>", 1, 1, 1), ("block", "<block>", 1, 1, 2)], ["re1", "re2"]),
        ("def rf\n  while rf1 do rf2 end\n  v = if rf3 then 1 else 2 end\n  return nil unless v\n  \"a #{rf4.map { |t| \"#{t} end\" }} end\"\nend\n", [("method", "rf", 1, 6, 1), ("block", "<block>", 5, 5, 2)], ["rf1", "rf2", "rf3", "rf4"]),
        ("class Rg\n  attr_accessor :end, :class\n  def name=(u); @n = u; end\n  def ==(o); o.class; end\n  def self.make; new.begin; end\nend\n", [("class", "Rg", 1, 6, 1), ("method", "name=", 3, 3, 2), ("method", "==", 4, 4, 2), ("method", "make", 5, 5, 2)], ["attr_accessor", "new"]),
        ("=begin\nclass No\n=end\ndef rh?(m)\n  case m\n  when 1 then rh1 / 2\n  else begin; rh2; rescue RhErr; end\n  end\nend # end\n", [("method", "rh?", 4, 9, 1)], ["rh1", "rh2", "RhErr"]),
        ("class Ri; end\nclass RiErr < Rstd; def go; 1; end; end\n", [("class", "Ri", 1, 1, 1), ("class", "RiErr", 2, 2, 1), ("method", "go", 2, 2, 2)], ["Rstd"]),
    ],
    "elixir": [
        ("defmodule Ea.B do\n  def f(x), do: x |> Ea1.go()\n  def none do\n    :ok\n  end\nend\n", [("module", "Ea.B", 1, 6, 1), ("function", "f", 2, 2, 2), ("function", "none", 3, 5, 2)], ["Ea1"]),
        ("defmodule Eb do\n  @doc \"\"\"\n  def no(x) do\n  \"\"\"\n  def g(x) when is_list(x) do\n    case x do\n      [] -> fn a -> a end\n      _ -> if Eb1.y(), do: 1, else: 2\n    end\n  end\nend\n", [("module", "Eb", 1, 11, 1), ("function", "<anonymous>", 5, 10, 2), ("anonymous_function", "<fn>", 7, 7, 3)], ["Eb1"]),
        ("defmodule Ec do\n  defp multi(a,\n             b)\n  do\n    ~s(end do) <> \"end #{Ec1.bar(fn -> b end)} #{a}\"\n  end\nend\n", [("module", "Ec", 1, 7, 1), ("function", "multi", 2, 6, 2), ("anonymous_function", "<fn>", 5, 5, 3)], ["Ec1"]),
        ("defmodule Ed do\n  defmacro m(x), do:\n    quote do: unquote(x)\n  def head(a, b \\\\ 1)\n  defguard is_p(v) when is_integer(v) and v > 0\nend\n", [("module", "Ed", 1, 6, 1), ("macro", "m", 2, 3, 2), ("function", "head", 4, 4, 2), ("guard", "is_p", 5, 5, 2)], []),
        ("defimpl Ee.Chars, for: Ee1 do\n  def to_string(u), do: %Ee2{u | n: 1}\nend\n", [("implementation", "Ee.Chars", 1, 3, 1), ("function", "to_string", 2, 2, 2)], ["Ee1", "Ee2"]),
        ("defprotocol Ef do\n  @spec size(t) :: integer\n  def size(data)\nend\n", [("protocol", "Ef", 1, 4, 1), ("function", "size", 3, 3, 2)], []),
        ("defmodule Eg do # end\n  use Eg1.Behaviour\n  def run(%{a: a} = m) do\n    with {:ok, r} <- Eg2.get(m) do r else _ -> a end\n  end\nend\n", [("module", "Eg", 1, 6, 1), ("function", "run", 3, 5, 2)], ["Eg1", "Eg2"]),
    ],
}
