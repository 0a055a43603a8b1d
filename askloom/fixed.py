"""Values that results depend on and that must not drift.

Message texts, prompt wording, defaults and the tool catalogue are part of the
data contract: stored outputs and logged runs carry them verbatim.
"""

# The characters a text strip removes (Unicode whitespace).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Chunking, search and clipping parameters.
PARAGRAPH_DELIMITER = "\n\n"
HEADING_MARK = "#"
TOP_K = 3
MIN_SCORE = 0.3
VECTOR_WIDTH = 384
SCORE_DIGITS = 4
PREVIEW_CHARS = 100
SHORT_PREVIEW_CHARS = 80
RESULT_CHARS = 200
MAX_STEPS = 5

# Request defaults.
DEFAULT_SESSION = "default"
GENERATE_MODEL = "llama3.2:3b"
AGENT_MODEL = "llama3.1:8b"
CHAT_AGENT_MODEL = "meta-llama/Meta-Llama-3.1-8B-Instruct"

# Message texts.
NO_ANSWER = (
    "I could not find relevant information in my knowledge base to answer that question."
)
NO_STREAM_ANSWER = "I could not find relevant information to answer that question."
NO_KNOWLEDGE = "No relevant information found in the knowledge base."
REPEATED_CALL = "(already computed — see previous result)"
STEPS_EXHAUSTED = "Max steps reached"
SYSTEM_TEXT = (
    "You are a helpful assistant with access to tools. "
    "Once you have the result from a tool, use it directly to answer — "
    "do not call the same tool again. "
    "Always use the exact values returned by tools without modifying them."
)

# Grounded prompt wording, in the order it is written around
# the context and the question.
PROMPT_HEAD = (
    "You are a helpful assistant. Answer the question using ONLY the context provided below.\n"
    "If the context does not contain enough information, say so honestly.\n\nContext:\n"
)
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_TAIL = "\n\nAnswer:"
SOURCE_LINE = "Source %d: %s"

# The weather line around its two numbers, and what ends a preview.
WEATHER_TEMPERATURE = "Temperature: "
WEATHER_WIND = "°C, Wind: "
WEATHER_END = " km/h"
PREVIEW_END = "..."

# Reply wire formats.
FRAME_MARK = "\n---\n"
SSE_PREFIX = "data: "
SSE_DONE = "[DONE]"

# Tool names with their required arguments.
TOOL_CATALOGUE = [
    ("get_current_time", []),
    ("calculate", ["expression"]),
    ("get_weather", ["latitude", "longitude"]),
    ("search_knowledge_base", ["query"]),
]

# Tool names with the types of their parameters.
TOOL_PARAMETERS = {
    "get_current_time": {"type": "object", "properties": {}},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "get_weather": {
        "type": "object",
        "properties": {"latitude": {"type": "number"}, "longitude": {"type": "number"}},
        "required": ["latitude", "longitude"],
    },
    "search_knowledge_base": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]},
}

# The characters an arithmetic expression may hold.
EXPRESSION_CHARS = "0123456789+-*/(). "
