"""Code for the catalogue's queries on parsing: one file a language, in which ``__ID__`` stands for the number of a row."""

from __future__ import annotations

SAMPLES: dict[str, tuple[str, str]] = {
    "python": ("src/app/f__ID__.py", '''import os.path, json as j
from .pkg__ID__ import a, b as c
from lib__ID__ import *

@deco
class K__ID__(Base):
    def m(self, q):
        return helper__ID__(q) + os.path.join("x") + j.dumps(c)

async def g__ID__():
    z = len(K__ID__)
    return z
'''),
    "javascript": ("web/f__ID__.js", '''import first, { one, two as deux } from './lib/u__ID__.js';
import * as ns from "pkg";
const { p, q: r } = require('../dep__ID__');
// function notThis() {
class Box__ID__ extends Base {
  open(key) {
    return helper__ID__(key, this.x) + deux;
  }
}
const make__ID__ = async (a, b) => {
  return ns.run(a, `${inner__ID__(b)} text`);
};
function* gen__ID__() { yield 1; }
export function top__ID__(x) { return x + "function fake() {"; }
'''),
    "typescript": ("web/f__ID__.ts", '''import type { T } from './t';
import { A__ID__ } from './a__ID__';
namespace N__ID__ {
  export function inner__ID__(v: number): string { return A__ID__(v); }
}
class Store__ID__ {
  private load(key: string): void {
    fetch__ID__(key);
  }
}
'''),
    "java": ("src/main/java/com/acme/f__ID__/Main.java", '''package x;
import java.util.List;
import com.acme.util.Helper__ID__;
import static com.acme.Tools.run__ID__;
import com.acme.all.*;
public class Main__ID__ {
    public Main__ID__(int n) { this.n = n; }
    @Override
    public String go__ID__(List<String> in) throws Exception {
        in.forEach(x -> Helper__ID__.use(x));
        return run__ID__(in);
    }
}
interface Shape__ID__ { }
'''),
    "go": ("server/f__ID__.go", '''package main

import (
    "fmt"
    m "acme.io/app/model__ID__"
    _ "side"
)

import "os"

func (s *Server) Run__ID__(ctx Ctx) error {
    v := m.New(ctx)
    fmt.Println(v)
    return nil
}

func main__ID__() {
    go func() {
        work__ID__()
    }()
}
'''),
    "ruby": ("lib/f__ID__.rb", '''require 'json'
require_relative 'help/h__ID__'
autoload :Late__ID__, 'late'

module Shop__ID__
  class Cart__ID__
    def add__ID__(item)
      if item
        items.each do |i|
          Helper__ID__.check(i)
        end
      end
    end
    def one__ID__; 1; end
  end
end
'''),
    "php": ("src/F__ID__.php", '''<?php
use App\\Models\\User__ID__;
use App\\Util\\{First__ID__, Second as Sec__ID__};
require __DIR__ . '/boot__ID__.php';
trait Named__ID__ { }
class Page__ID__ extends Base {
    public function show__ID__($id) {
        $f = function ($x) { return $x; };
        return User__ID__::find($id) . strlen($id);
    }
}
function helper__ID__($a) { return Sec__ID__::go($a); }
'''),
    "elixir": ("lib/shop/f__ID__.ex", '''defmodule Shop.Cart__ID__ do
  alias Shop.{Item__ID__, User}
  alias Shop.Long.Name__ID__, as: Short__ID__
  import Enum, only: [map: 2]
  use GenServer

  def add__ID__(cart, item) do
    if item do
      Item__ID__.check(item)
    end
    fn x -> x end
  end
end
'''),
}
