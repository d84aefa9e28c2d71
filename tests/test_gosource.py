import pytest

from loomline.sources import gosource as g


def only(body):
    return g.functions("package main\n" + body)[0]


def test_identity_hashes():
    assert only("func add(a, b int) int {\n\treturn a + b\n}")["hash"] == "53a50ecb5bb5eb2b"
    assert only("func add(x, y int) int {\n\treturn x + y\n}")["hash"] == "e0b006473e216e09"
    assert g.identity_hash("test", "func()", 0, 0, 0, None) == "c3179d798c7d09fc"


def test_token_string():
    f = only("func multiply(a, b int) int {\n\treturn a * b\n}")
    assert f["token_str"] == "func IDENT ( IDENT , IDENT int ) int { return IDENT * IDENT \n } \n"
    assert f["ret_binop"] and f["stmt_kinds"] == ["*ast.ReturnStmt"]


def test_complexity_and_shape():
    f = only("func f(x int, s *T) (int, error) {\n\tfor i := 0; i < x; i++ {\n\t\tif x > 1 {\n\t\t\tx++\n\t\t}\n\t}\n\tswitch x {\n\tcase 1:\n\tdefault:\n\t}\n\treturn x, nil\n}")
    assert f["complexity"] == 6
    assert f["shape_sig"] == "f_*ast.Ident_*ast.StarExpr_*ast.Ident_*ast.Ident"
    assert f["signature"] == "func(x int, s *T) (int, error)" and f["struct_sig"] == "func(int, *ID) (int, error)"
    assert f["stmt_kinds"] == ["*ast.ForStmt", "*ast.SwitchStmt", "*ast.ReturnStmt"]


HEADERS = {
    "for i := 0; i < n; i++ {\n\t}": ["For"],
    "if y := x; y > 1 {\n\t} else if z := y; z > 0 {\n\t} else {\n\t}\n\tx++": ["If", "IncDec"],
    "switch y := f(x); y {\n\tcase 1:\n\t\tx++\n\t}": ["Switch"],
    "switch y := v.(type) {\n\tcase int:\n\t}": ["TypeSwitch"],
    "for _, x := range []int{1, 2} {\n\t}\n\treturn": ["Range", "Return"],
    "for k := range map[string]T{\"a\": {1}} {\n\t}": ["Range"],
    "for xs := []int{1}; len(xs) > 0; xs = xs[1:] {\n\t}\n\tx = a[i]": ["For", "Assign"],
    "for f := func(s struct{ a int }) bool { return true }; f(v); {\n\t}": ["For"],
    "for i, x := 0, []int{1}; i < 2; x = []int{2} {\n\t}": ["For"],
    "if (T{1}) == v && a[i] {\n\t}": ["If"],
    "switch a[i] {\n\tdefault:\n\t}": ["Switch"],
    "again:\n\tfor i := 0; i < n; i++ {\n\t\tcontinue again\n\t}": ["Labeled"],
    "for {\n\t}": ["For"],
    "select {\n\tcase c <- 1:\n\t}": ["Select"],
    "c <- 1; go f(); defer func() { x++ }()": ["Send", "Go", "Defer"],
    "x := struct{ a int }{1}; var y interface{} = x; _ = y": ["Assign", "Decl", "Assign"],
    "{\n\t\tx := 1; _ = x\n\t}": ["Block"],
}


@pytest.mark.parametrize("body", HEADERS)
def test_header_semicolons(body):
    assert only("func f() {\n\t" + body + "\n}")["stmt_kinds"] == [f"*ast.{k}Stmt" for k in HEADERS[body]]


def test_broken_files_give_an_error():
    for text in ("package p\nfunc f( {\n}", "func f() {}", "package p\nfunc f() {\n", "package p\n}"):
        with pytest.raises(g.GoSyntaxError):
            g.functions(text)
