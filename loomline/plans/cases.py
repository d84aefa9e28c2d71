"""The ten labelled cases, and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.config import Options
from loomline.functions import metrics as M
from loomline.sources.scan import parse_functions, with_lengths

#: Name, two sources, expected similarity, category.
CASES = (
    (
        "identical_functions",
        """package main
func add(a, b int) int {
	return a + b
}""",
        """package main
func add(a, b int) int {
	return a + b
}""",
        1.0,
        "identical",
    ),
    (
        "same_logic_different_vars",
        """package main
func calculateSum(x, y int) int {
	result := x + y
	return result
}""",
        """package main
func addNumbers(a, b int) int {
	sum := a + b
	return sum
}""",
        0.85,
        "high_similar",
    ),
    (
        "same_structure_minor_diff",
        """package main
func processData(data []int) int {
	total := 0
	for _, value := range data {
		total += value
	}
	return total
}""",
        """package main
func sumSlice(numbers []int) int {
	sum := 0
	for _, num := range numbers {
		sum += num
	}
	return sum
}""",
        0.9,
        "high_similar",
    ),
    (
        "similar_pattern_different_ops",
        """package main
func multiply(a, b int) int {
	return a * b
}""",
        """package main
func divide(a, b int) int {
	return a / b
}""",
        0.7,
        "medium_similar",
    ),
    (
        "similar_control_flow",
        """package main
func findMax(data []int) int {
	max := data[0]
	for i := 1; i < len(data); i++ {
		if data[i] > max {
			max = data[i]
		}
	}
	return max
}""",
        """package main
func findMin(numbers []int) int {
	min := numbers[0]
	for i := 1; i < len(numbers); i++ {
		if numbers[i] < min {
			min = numbers[i]
		}
	}
	return min
}""",
        0.75,
        "medium_similar",
    ),
    (
        "same_signature_different_impl",
        """package main
func process(data []int) []int {
	result := make([]int, len(data))
	for i, v := range data {
		result[i] = v * 2
	}
	return result
}""",
        """package main
func process(data []int) []int {
	var result []int
	for _, v := range data {
		if v > 0 {
			result = append(result, v)
		}
	}
	return result
}""",
        0.4,
        "low_similar",
    ),
    (
        "completely_different",
        """package main
func fibonacci(n int) int {
	if n <= 1 {
		return n
	}
	return fibonacci(n-1) + fibonacci(n-2)
}""",
        """package main
func printHello(name string) {
	fmt.Printf("Hello, %s!\\n", name)
}""",
        0.1,
        "different",
    ),
    (
        "interface_implementations",
        """package main
type Writer interface {
	Write([]byte) (int, error)
}

func (w *MyWriter) Write(data []byte) (int, error) {
	return len(data), nil
}""",
        """package main
type Writer interface {
	Write([]byte) (int, error)
}

func (w *AnotherWriter) Write(bytes []byte) (int, error) {
	return len(bytes), nil
}""",
        0.9,
        "high_similar",
    ),
    (
        "error_handling_patterns",
        """package main
func readFile(filename string) ([]byte, error) {
	data, err := os.ReadFile(filename)
	if err != nil {
		return nil, fmt.Errorf("failed to read file: %w", err)
	}
	return data, nil
}""",
        """package main
func loadData(path string) ([]byte, error) {
	content, err := os.ReadFile(path)
	if err != nil {
		return nil, fmt.Errorf("error reading file: %w", err)
	}
	return content, nil
}""",
        0.85,
        "high_similar",
    ),
    (
        "goroutine_patterns",
        """package main
func processAsync(data []int, result chan<- int) {
	go func() {
		defer close(result)
		sum := 0
		for _, v := range data {
			sum += v
		}
		result <- sum
	}()
}""",
        """package main
func calculateAsync(numbers []int, output chan<- int) {
	go func() {
		defer close(output)
		total := 0
		for _, num := range numbers {
			total += num
		}
		output <- total
	}()
}""",
        0.9,
        "high_similar",
    ),
)


def scored(pairs: DataFrame, options: Options | None = None) -> DataFrame:
    """Adds exact, tree, tok, structural, sig and actual to pairs of units (a_ and b_ columns)."""
    options = options or Options()
    w = options.weights
    same = F.col("a_hash") == F.col("b_hash")
    pairs = pairs.withColumn("fits", same | M.may_be_similar(options)).withColumn("exact", same | (F.col("fits") & (F.col("a_norm_hash") == F.col("b_norm_hash"))))
    pairs = pairs.withColumns({"tree": M.tree_similarity(), "tok": M.token_similarity(), "structural": M.structural_similarity(options), "sig": M.signature_similarity()})
    total = w.tree_edit * F.col("tree") + w.token_similarity * F.col("tok") + w.structural * F.col("structural") + w.signature * F.col("sig")
    return pairs.withColumn("actual", F.when(F.col("exact"), 1.0).when(~F.col("fits"), 0.0).otherwise(total))


def case_results(spark: SparkSession, options: Options | None = None) -> DataFrame:
    """idx, case_name, expected, actual, category and the components of every case."""
    rows = [(f"{i}/{side}.go", text) for i, (_, *texts, _, _) in enumerate(CASES) for side, text in enumerate(texts)]
    units = with_lengths(parse_functions(spark.createDataFrame(rows, "path string, content string")))
    units = units.withColumn("idx", F.substring_index("file", "/", 1).cast("int"))
    left = units.filter(F.col("file").endswith("/0.go")).select("idx", *(F.col(c).alias("a_" + c) for c in units.columns if c != "idx"))
    right = units.filter(F.col("file").endswith("/1.go")).select("idx", *(F.col(c).alias("b_" + c) for c in units.columns if c != "idx"))
    told = spark.createDataFrame([(i, c[0], c[3], c[4]) for i, c in enumerate(CASES)], "idx int, case_name string, expected double, category string")
    out = scored(left.join(right, "idx"), options).join(told, "idx")
    return out.select("idx", "case_name", "category", "expected", "actual", "exact", "tree", "tok", "structural", "sig")
