"""Schemas of the files the library reads, as DDL."""

LABELS = "BlockId string, Label string"

# The columns of a result table, in file order.
RESULTS = (
    "start_time string, config_name string, provider string, model string, workflow string, "
    "preprocessing boolean, embeddings boolean, question_id string, question string, "
    "answer_type string, expected string, answer string, correct boolean, reason string, "
    "time_seconds double, tokens_input long, tokens_output long, tokens_total long, error string"
)
RESULT_COLUMNS = [field.split()[0] for field in RESULTS.split(", ")]

TEST_COLUMNS = (
    "block_id string, blk_id string, expected_label int, predicted_label int, "
    "correct boolean, detection_raw string, explanation string"
)
TEST_RESULT = f"struct<{TEST_COLUMNS}>"
METRICS = (
    "struct<TP: long, TN: long, FP: long, FN: long, accuracy: double, precision: double, "
    "recall: double, f1: double, unparseable: long, total: long>"
)
EVALUATION = (
    "metadata struct<timestamp: string, experiment: string, prompt_variant: string, "
    "pipeline: string, provider: string, model: string, prompts: map<string, string>>, "
    f"metrics {METRICS}, summary {METRICS}, test_results array<{TEST_RESULT}>"
)

CONFIG = (
    "name string, task string, provider string, model string, pipeline string, "
    "description string, workflow string, prompts map<string, string>, "
    "use_preprocessing boolean, preprocessing boolean, use_embeddings boolean, "
    "embeddings boolean, max_iterations int, tools_available array<string>, "
    "tools_unavailable array<string>, agents_available array<string>"
)

TOOL_CALL = "struct<name: string, arguments: string, id: string>"
TOOL_RESULT = "struct<name: string, arguments: string, id: string, result: string>"
USAGE = "struct<input_tokens: long, output_tokens: long, total_tokens: long>"
ITERATION = (
    "struct<iteration: int, timestamp: double, response: string, "
    f"tool_calls: array<{TOOL_CALL}>, "
    f"model_info: struct<model: string, usage: {USAGE}, finish_reason: string>, "
    f"tool_call_results: array<{TOOL_RESULT}>>"
)
INTERACTION = (
    "struct<agent: string, parent: string, message: string, context: string, "
    "start_time: double, duration: double, result: string, total_tool_calls: long, "
    f"iterations: array<{ITERATION}>>"
)
RUN_LOG = (
    "session_id string, timestamp string, task string, config map<string, string>, "
    f"duration double, final_result string, interactions array<{INTERACTION}>"
)
