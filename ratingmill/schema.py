"""The engine's row types. Schemas are declared, never inferred."""

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"
SIGNED = "struct<attribute:string,side:string>"
CORPUS = f"prompt_id string, prompt string, messages {MESSAGES}, split string"
ITEMS = f"split string, user_id string, user_attributes array<{SIGNED}>, conversation_history array<{MESSAGES}>, current_messages {MESSAGES}"
USERS = f"user_idx int, rewrite_style_attributes array<{SIGNED}>, conversations array<struct<conversation_id:string,messages:{MESSAGES}>>"
RESPONSE = "struct<content:string,reasoning:string,raw_text:string,finish_reason_stop:boolean>"
GENERATED = "id int, prompt_id int, attribute string, side string, prompt string, response string"
RATINGS = "conv_ord long, attr_ord int, attribute string, score double"
PAIR_SCORES = "judge string, pair_ord int, pair string, rep long, slot int, score double"
BIAS = "model string, system_prompt string, persona_id int, persona string, prompt_id int, prompt string, response string, score int"

# fixed values: antonym pairs by which judges are compared
ANTONYMS = (
    ("verbose", "terse"),
    ("formal", "casual"),
    ("warm", "cold"),
    ("serious", "playful"),
    ("objective", "subjective"),
    ("structured", "unstructured"),
)
