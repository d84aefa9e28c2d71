"""A few Go files, and what their functions are, worked out by hand."""

from __future__ import annotations

GO_FILES = {
    "pkg/math.go": """package mathx

func Add(a, b int) int {
	return a + b
}

func Max(a, b int) int {
	if a > b {
		return a
	}
	return b
}
""",
    "pkg/loop.go": """package loops

func Sum(xs []int) (total int) {
	for i := 0; i < len(xs); i++ {
		total += xs[i]
	}
	return total
}

func Kind(n int) string {
	switch m := n % 3; m {
	case 0:
		return "zero"
	default:
		return "other"
	}
}
""",
    "pkg/store.go": """package store

type Store struct {
	items map[string]int
}

func (s *Store) Get(key string) (int, error) {
	v, ok := s.items[key]
	if !ok {
		return 0, errMissing
	}
	return v, nil
}

func (s *Store) Watch(c chan<- int) {
	go func() {
		defer close(c)
		c <- len(s.items)
	}()
}
""",
    "pkg/generic.go": """package generic

func Keys[K comparable, V any](m map[K]V) []K {
	out := make([]K, 0, len(m))
	for k := range m {
		out = append(out, k)
	}
	return out
}
""",
    "pkg/none.go": "package none\n\nvar X = 1\n",
    "pkg/broken.go": "package broken\n\nfunc f( {\n",
    "pkg/math_test.go": "package mathx\n\nfunc TestAdd(t *testing.T) {\n}\n",
    "vendor/x/x.go": "package x\n\nfunc X() {\n}\n",
}

#: By hand: file, package, name, first and last line, signature, complexity, statements (without ``*ast.`` and ``Stmt``), whether a returned value is a binary expression.
_FUNCTIONS = """('pkg/math.go', 'mathx', 'Add', 3, 5, 'func(a, b int) int', 1, 'Return', true),
('pkg/math.go', 'mathx', 'Max', 7, 12, 'func(a, b int) int', 2, 'If Return', false),
('pkg/loop.go', 'loops', 'Sum', 3, 8, 'func(xs []int) (total int)', 2, 'For Return', false),
('pkg/loop.go', 'loops', 'Kind', 10, 17, 'func(n int) string', 4, 'Switch', false),
('pkg/store.go', 'store', 'Get', 7, 13, 'func(key string) (int, error)', 2, 'Assign If Return', false),
('pkg/store.go', 'store', 'Watch', 15, 20, 'func(c chan<- int)', 1, 'Go', false),
('pkg/generic.go', 'generic', 'Keys', 3, 9, 'func[K comparable, V any](m map[K]V) []K', 2, 'Assign Range Return', false)"""
GO_FUNCTIONS_SQL = f"""SELECT file, package, name, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, signature, CAST(c AS INTEGER) AS complexity,
array_to_string(list_transform(string_split(kinds, ' '), lambda k: '*ast.' || k || 'Stmt'), ' ') AS stmt_kinds, ret_binop
FROM (VALUES {_FUNCTIONS}) t(file, package, name, a, b, signature, c, kinds, ret_binop)"""

#: By hand: file, name, tokens (``~`` is an automatic semicolon), signature by structure, shape.
_FEATURES = """('pkg/math.go', 'Add', 'func IDENT ( IDENT , IDENT int ) int { return IDENT + IDENT ~ } ~', 'func(int) int', 'Add_*ast.Ident_*ast.Ident'),
('pkg/math.go', 'Max', 'func IDENT ( IDENT , IDENT int ) int { if IDENT > IDENT { return IDENT ~ } ~ return IDENT ~ } ~', 'func(int) int', 'Max_*ast.Ident_*ast.Ident'),
('pkg/loop.go', 'Sum', 'func IDENT ( IDENT [ ] int ) ( IDENT int ) { for IDENT := NUMBER ; IDENT < IDENT ( IDENT ) ; IDENT ++ { IDENT += IDENT [ IDENT ] ~ } ~ return IDENT ~ } ~', 'func(unknown) int', 'Sum_*ast.ArrayType_*ast.Ident'),
('pkg/loop.go', 'Kind', 'func IDENT ( IDENT int ) string { switch IDENT := IDENT % NUMBER ; IDENT { case NUMBER : return STRING ~ default : return STRING ~ } ~ } ~', 'func(int) string', 'Kind_*ast.Ident_*ast.Ident'),
('pkg/store.go', 'Get', 'func ( IDENT * IDENT ) IDENT ( IDENT string ) ( int , IDENT ) { IDENT , IDENT := IDENT . IDENT [ IDENT ] ~ if ! IDENT { return NUMBER , IDENT ~ } ~ return IDENT , IDENT ~ } ~', 'func(string) (int, error)', 'Get_*ast.Ident_*ast.Ident_*ast.Ident'),
('pkg/store.go', 'Watch', 'func ( IDENT * IDENT ) IDENT ( IDENT chan <- int ) { go func ( ) { defer IDENT ( IDENT ) ~ IDENT <- IDENT ( IDENT . IDENT ) ~ } ( ) ~ } ~', 'func(unknown)', 'Watch_*ast.ChanType'),
('pkg/generic.go', 'Keys', 'func IDENT [ IDENT IDENT , IDENT IDENT ] ( IDENT map [ IDENT ] IDENT ) [ ] IDENT { IDENT := IDENT ( [ ] IDENT , NUMBER , IDENT ( IDENT ) ) ~ for IDENT := range IDENT { IDENT = IDENT ( IDENT , IDENT ) ~ } ~ return IDENT ~ } ~', 'func(unknown) unknown', 'Keys_*ast.MapType_*ast.ArrayType')"""
GO_FEATURES_SQL = f"""SELECT f.file, f.name, replace(tokens, '~', chr(10)) AS token_str, struct_sig, shape_sig,
substr(sha256('[' || f.name || ' ' || signature || ' lines:' || a || '-' || b || ' count:' || (b - a + 1) || ' stmts:' || len(string_split(kinds, ' ')) || ']'), 1, 16) AS hash, CAST(strlen(tokens) AS BIGINT) AS tok_len
FROM (VALUES {_FEATURES}) f(file, name, tokens, struct_sig, shape_sig) JOIN (VALUES {_FUNCTIONS}) t(file, package, name, a, b, signature, c, kinds, ret_binop) ON f.file = t.file AND f.name = t.name"""
