"""Ecore files: a model with a cycle of opposite references, read, drawn and read back."""
import os
import tempfile

import pytest

from ermine.sources import ecore as EC
from ermine.sources import models as S

NS = ('xmlns:xmi="http://www.omg.org/XMI" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
      'xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore"')
LIB = f"""<?xml version="1.0" encoding="UTF-8"?>
<ecore:EPackage xmi:version="2.0" {NS} name="library">
  <eClassifiers xsi:type="ecore:EClass" name="Book" eSuperTypes="#//Item //@eClassifiers.4">
    <eStructuralFeatures xsi:type="ecore:EAttribute" name="title" lowerBound="1"
        eType="ecore:EDataType http://www.eclipse.org/emf/2002/Ecore#//EString"/>
    <eStructuralFeatures xsi:type="ecore:EReference" name="authors" lowerBound="1" upperBound="-1" eType="#//Author"
        eOpposite="#//Author/books"/>
    <eStructuralFeatures xsi:type="ecore:EAttribute" name="genre" eType="#//Genre"/>
  </eClassifiers>
  <eClassifiers xsi:type="ecore:EClass" name="Author">
    <eStructuralFeatures xsi:type="ecore:EReference" name="books" upperBound="-1" eType="//@eClassifiers.0" containment="true"
        eOpposite="#//Book/authors"/>
    <eStructuralFeatures xsi:type="ecore:EReference" name="friend" eType="#//Author" eOpposite="#//Author/friend"/>
    <eStructuralFeatures xsi:type="ecore:EReference" name="desk" upperBound="3" eType="#//Item" containment="true"/>
  </eClassifiers>
  <eClassifiers xsi:type="ecore:EEnum" name="Genre"><eLiterals name="novel"/><eLiterals name="poem" value="1"/></eClassifiers>
  <eClassifiers xsi:type="ecore:EClass" name="Item" interface="true" abstract="true"/>
  <eClassifiers xsi:type="ecore:EClass" name="Thing"/>
  <eClassifiers xsi:type="ecore:EDataType" name="Url"/>
</ecore:EPackage>
"""
TEXT = """@startuml
!theme plain
package library {
class Book {
\t title : EString
\t genre : Genre
}
Item <|-- Book
Thing <|-- Book
Book "authors 1..*" --* "books 0..*" Author
class Author {
}
Author "friend 0..1" --> Author
Author "desk 0..*" *--> Item
enum Genre {
novel
poem
}
interface Item {
}
class Thing {
}
class Url << (D,orchid) EDataType>>
}
@enduml"""


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="ermine-ecore-", dir="/tmp")
    with open(f"{d}/lib_rel3.ecore", "w") as f:
        f.write(LIB)
    with open(f"{d}/empty.ecore", "w") as f:
        f.write(f'<ecore:EPackage {NS} name="none"/>')
    return d


def test_read(spark, folder):
    c, a, r = EC.read_ecore(spark, folder)
    assert [(x.model, x.class_name) for x in c.orderBy("class_pos").collect()] == [
        ("lib", n) for n in ("Book", "Author", "Item", "Thing")]
    assert sorted((x.class_name, x.attr_pos, x.attr_name, x.attr_type) for x in a.collect()) == [
        ("Book", 0, "title", "EString"), ("Book", 2, "genre", "Genre")]
    assert sorted((x.src, x.dst, x.mult, x.rel_name, x.containment, x.opposite) for x in r.collect()) == [
        ("Author", "Author", "0..1", "friend", False, "friend"), ("Author", "Book", "0..*", "books", True, "authors"),
        ("Author", "Item", "0..*", "desk", True, None), ("Book", "Author", "1..*", "authors", False, "books")]
    assert [(x.src, x.rel_name) for x in EC.last_reference(r).collect()] == [("Author", "desk")]


def test_draw_and_read_back(spark, folder):
    lines = EC.ecore_lines(spark, folder)
    got = [x.line for x in lines.filter("model = 'lib'").orderBy("k0", "k1", "k2", "k3").collect()]
    assert "\n".join(got) == TEXT
    out = os.path.join(tempfile.mkdtemp(prefix="ermine-draw-", dir="/tmp"), "out")
    S.write_plantuml(lines, out)
    c, a, r = S.read_plantuml(spark, out)
    assert {(x.model, x.class_name) for x in c.collect()} == {("lib", n) for n in ("Book", "Author", "Item", "Thing")}
    assert {(x.class_name, x.attr_name, x.attr_type) for x in a.collect()} == {("Book", "title", "EString"), ("Book", "genre", "Genre")}
    assert sorted((x.src, x.dst, x.mult, x.rel_name) for x in r.collect()) == [
        ("Author", "Author", "0..1", "friend"), ("Author", "Book", "0..*", "books"), ("Author", "Item", "0..*", "desk"),
        ("Book", "Author", "1..*", "authors")]
