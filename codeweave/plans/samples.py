"""Small source files of each language, with the elements that extraction must find in them."""

SAMPLES = {
    "python": ('''import os, sys
from . import a, b
from ..pkg.mod import thing as t

class Base(object):
    def run(self, x: int = 1) -> bool:
        def inner(): pass
        return True

class _Child(Base, mod.Mixin):
    @property
    async def go(self):
        pass

async def main(argv): pass
def _hidden(): return 1
''', {"functions": [("main", True), ("_hidden", False)], "methods": [("Base", "run"), ("_Child", "go")], "classes": [("Base", ["object"], []), ("_Child", ["Base", "mod.Mixin"], [])],
      "imports": [("sys", []), (".", ["a", "b"]), ("..pkg.mod", ["thing"])]}),
    "typescript": ('''import React, { useState as s, useRef } from 'react';
import * as fs from "fs";
const { join } = require("path");
// class Commented {}
export abstract class Shape<T> extends Base<T> implements Drawable, Named {
  private size: number = 1;
  constructor(x: number) { super(); if (x) { run(x); } }
  static async make(a: string, b?: number): Promise<Shape> { return helper(a); }
  abstract area(): number;
  #hide() { return 1; }
}
interface Drawable extends Named { x: number; draw(): void }
export const enum Color { Red, Green = 2 }
export function top(a: number): string { function nested() {} return ""; }
const arrow = async (x) => x + 1;
let plain = (1 + 2);
class Quiet {}
export default Quiet;
export { arrow as other } from './x';
''', {"functions": [("top", True), ("nested", True), ("arrow", False)], "methods": [("Shape", "constructor"), ("Shape", "make"), ("Shape", "area"), ("Shape", "#hide")],
      "classes": [("Shape", ["Base"], ["Drawable", "Named"]), ("Quiet", [], [])], "interfaces": ["Drawable"], "enums": ["Color"], "imports": [("react", ["React", "useState", "useRef"]), ("fs", []), ("path", ["join"])]}),
    "go": ('''package main
import (
	"fmt"
	str "strings"
	_ "embed"
)
type Store struct { n int }
type Reader interface { Read(p []byte) (int, error) }
func (s *Store) Get(k string) (int, error) { return 0, nil }
func Run(a int) error { return nil }
func hidden() {}
''', {"functions": [("Run", True), ("hidden", False)], "methods": [("Store", "Get")], "classes": [("Store", [], [])], "interfaces": ["Reader"], "imports": [("fmt", ["fmt"]), ("strings", ["str"]), ("embed", ["embed"])]}),
    "rust": ('''use std::io::{self, Read as R};
use crate::net::*;
pub struct Conn { a: u8 }
pub trait Talk { fn hello(&self) -> u8 { 1 } }
enum Kind { A, B }
impl Conn { pub fn open(a: u8) -> Self { Conn { a } } }
impl Talk for Conn { fn hello(&self) -> u8 { 2 } }
pub async fn serve(x: &str) -> Result<(), E> { Ok(()) }
''', {"functions": [("hello", False), ("serve", True)], "methods": [("Conn", "open"), ("Conn", "hello")], "classes": [("Conn", [], ["Talk"])], "interfaces": ["Talk"], "enums": ["Kind"],
      "imports": [("std::io", ["io"]), ("std::io::Read", ["R"]), ("crate::net", ["*crate::net"])]}),
    "java": ('''package a.b;
import java.util.List;
import static com.x.Util.*;
public class Foo<T> extends Bar<T> implements Baz, Qux {
  private int n = call(1);
  public Foo() { init(); }
  public static List<String> items(int a, String b) throws E { if (a > 0) { return run(a); } return null; }
  protected abstract void stop();
}
interface Baz { void go(); }
enum Level { LOW, HIGH }
''', {"methods": [("Foo", "items"), ("Foo", "stop"), (None, "go")], "classes": [("Foo", ["Bar"], ["Baz", "Qux"])], "interfaces": ["Baz"], "enums": ["Level"], "imports": [("java.util.List", ["List"]), ("com.x.Util", ["*"])]}),
    "c_sharp": ('''using System;
using static System.Math;
using Alias = Some.Type;
namespace A { public class Svc : BaseSvc, IRun { public async Task<int> Go(int a) { return await X(a); } private void Stop() { } }
  interface IRun { int Go(int a); } enum Mode { On, Off } }
''', {"methods": [("Svc", "Go"), ("Svc", "Stop"), (None, "Go")], "classes": [("Svc", ["BaseSvc", "IRun"], [])], "interfaces": ["IRun"], "enums": ["Mode"], "imports": [("System", ["*"]), ("System.Math", ["Math"]), ("Some.Type", ["Alias"])]}),
    "kotlin": ('''import a.b.C
import a.b.D as E
import x.y.*
open class Repo(val n: Int) : Base(n), Closeable { fun find(id: Int): String { return "" }
  private fun hide() {} }
object Single { fun one() = 1 }
interface Closeable { fun close() }
enum class Mode { A, B }
fun top(a: Int): Int = a
''', {"functions": [("top", True)], "methods": [("Repo", "find"), ("Repo", "hide"), ("Single", "one"), ("Closeable", "close")], "classes": [("Repo", ["Base"], ["Closeable"]), ("Single", [], [])], "interfaces": ["Closeable"],
      "enums": ["Mode"], "imports": [("a.b.C", ["C"]), ("a.b.D", ["E"]), ("x.y", ["*"])]}),
    "scala": ('''import a.b.C
import a.{B, Old => New}
import x._
class Svc(n: Int) extends Base(n) with Log { def run(a: Int): Int = a }
object Svc { def make(): Svc = new Svc(1) }
trait Log { def log(s: String): Unit = println(s) }
''', {"methods": [("Svc", "run"), ("Svc", "make"), ("Log", "log")], "classes": [("Svc", ["Base", "Log"], []), ("Svc", [], [])], "interfaces": ["Log"], "imports": [("a.b.C", ["C"]), ("a.B", ["B"]), ("a.Old", ["New"]), ("x", ["*"])]}),
    "dart": ('''import 'dart:io';
export 'src/a.dart';
abstract class Shape extends Base with Mix implements Draw { double area(int x) { return f(x); } static Shape make() { return null; } }
enum Color { red, green }
int top(String a) { return 1; }
void _low() {}
''', {"functions": [("top", True), ("_low", False)], "methods": [("Shape", "area"), ("Shape", "make")], "classes": [("Shape", ["Base"], ["Draw"])], "enums": ["Color"], "imports": [("dart:io", []), ("src/a.dart", [])]}),
    "swift": ('''import Foundation
import struct Core.Thing
class View: Base, Drawable { func draw(x: Int) -> Bool { return true } private func low() {} }
struct Point { func len() -> Int { 1 } }
protocol Drawable { func draw(x: Int) -> Bool }
enum Kind { case a }
func top(a: Int) -> String { "" }
''', {"functions": [("draw", True), ("top", True)], "methods": [("View", "draw"), ("View", "low"), ("Point", "len")], "classes": [("View", ["Base", "Drawable"], []), ("Point", [], [])], "interfaces": ["Drawable"], "enums": ["Kind"],
      "imports": [("Foundation", []), ("Core", ["Thing"])]}),
    "php": ('''<?php
use App\\Models\\User;
use App\\{A, B as C};
require_once './boot.php';
abstract class Ctl extends Base implements Runs { public static function go(int $a): bool { return run($a); } private function low() {} }
trait Logs { function log() {} }
interface Runs { public function go(int $a): bool; }
function top($a) { return 1; }
''', {"functions": [("top", True)], "methods": [("Ctl", "go"), ("Ctl", "low"), ("Logs", "log"), (None, "go")], "classes": [("Ctl", ["Base"], ["Runs"]), ("Logs", [], [])], "interfaces": ["Runs"],
      "imports": [("App\\Models\\User", ["User"]), ("App\\A", ["A"]), ("App\\B", ["B"]), ("./boot.php", [])]}),
    "ruby": ('''require 'json'
require_relative "lib/a"
module Tools
  class Runner < Base::Thing
    def run(a, b = 1)
      if a then b end
      items.each do |x|
        puts x
      end
    end
    def self.make; new; end
  end
end
def top(x)
  x = if x
    1
  end
end
''', {"functions": [("top", True)], "methods": [("Runner", "run"), ("Runner", "make")], "classes": [("Tools", [], []), ("Runner", ["Base::Thing"], [])], "imports": [("json", []), ("lib/a", [])]}),
    "c": ('''#include <stdio.h>
#include "api.h"
enum kind { A, B };
static int low(int a) { return run(a); }
int top(const char *s, int n) {
  if (n) { return low(n); }
  return 0;
}
void proto(void);
''', {"functions": [("low", False), ("top", True), ("proto", True)], "enums": ["kind"], "imports": [("stdio.h", []), ("api.h", [])]}),
    "cpp": ('''#include "a.hpp"
class Node : public Base, private Other { public: int size(int a) const { return a; } void stop(); };
struct Plain { int n; };
enum class Color { red };
int Node::depth(int x) { return x; }
static void low() {}
''', {"functions": [("low", False)], "methods": [("Node", "size"), ("Node", "stop"), ("Node", "depth")], "classes": [("Node", ["Base", "Other"], []), ("Plain", [], [])], "enums": ["Color"], "imports": [("a.hpp", [])]}),
    "vue": ('''<template><div>class No {}</div></template>
<script lang="ts">
import { ref } from 'vue'
export function setup(a) { return a }
</script>
<style>.x{}</style>
''', {"functions": [("setup", True)], "imports": [("vue", ["ref"])]}),
}
