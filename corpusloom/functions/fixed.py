"""Literals that the article layout, the prompts and the chat
templates are defined by. They must stay exactly as they are, in this order."""

# --- text repair: literal replacements, applied in this order -------------
TEXT_REPAIRS = [
    ("hành v i", "hành vi"),
    ("v i ", "vi "),
    ("ớn lạnh", "run lạnh"),
    ("chọc dọ", "chọc dò"),
    ("thài ra", "thải ra"),
]

# --- article text layout ---------------------------------------------------
TITLE_MARK = "TIÊU ĐỀ:"
URL_MARK = "URL:"
BODY_MARK = "NỘI DUNG:"
PARTS_MARK = "CÁC PHẦN CHI TIẾT:"
RULE = "=" * 80

# --- contributors ----------------------------------------------------------
AUTHOR_LEAD = "Theo"
REVIEWER_LEAD = "Xem xét bởi"
REVIEWED = "Đã xem xét"
DEGREES = [",", "MD", "PhD", "MPH", "MACP"]
AUTHOR_ORGANISATIONS = ["University", "College", "School", "Hospital", "Center"]
REVIEWER_ORGANISATIONS = ["University", "College", "School", "Hospital", "Center", "Division"]

# --- body ------------------------------------------------------------------
REVISION_LEAD = "Đã xem xét/Đã chỉnh sửa"
HEADER_WORDS = [
    "Theo", "Xem xét bởi", "Đã xem xét", "Đã chỉnh sửa",
    "MD,", "PhD,", "University", "College", "Hospital",
    "v_vi", "Thg", "đã sửa đổi",
]
FOOTERS = [
    "Test your Knowledge", "Take a Quiz!", "Bản quyền",
    "© 2025", "© 2024", "© 2023", "Merck & Co.",
]

# --- cross references ------------------------------------------------------
REFERENCE_LEAD = "Xem thêm"
REFERENCE_STOPS = ["Đã xem xét", "đã sửa đổi", "Thg", "_vi"]

# --- section headings ------------------------------------------------------
SECTION_HEADERS = [
    "Căn nguyên", "Sinh lý bệnh", "Triệu chứng và Dấu hiệu", "Triệu chứng",
    "Chẩn đoán", "Điều trị", "Phòng ngừa", "Những điểm chính",
    "Tiên lượng", "Phân loại", "Các biến chứng",
]
# Capitals that may open a section; deliberately without Đ, Ò, Ù, Ỳ and kin.
SECTION_CAPITALS = "A-ZÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊ"

# --- crawl -----------------------------------------------------------------
BODY_SELECTORS = [("div", "topic__content"), ("div", "content-body"), ("article", None), ("main", None)]
SITEMAP_CHILD_PART = "topic.xml"
SITEMAP_PAGE_PART = "/professional/"
LINK_PART = "/vi/professional/"

# --- chunks and search -----------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", ", ", " "]
EMBED_TITLE_LABEL = "Tiêu đề: "
EMBED_BODY_LABEL = "Nội dung: "
INTENT_THRESHOLD = 0.3
DOCUMENT_FLOOR = 0.4
INTENT_DOMAIN = "medical_question"
INTENT_CHAT = "chitchat"

# --- conversation and prompts ---------------------------------------------
DEFAULT_SESSION = "default_api_session"
HISTORY_USER = "Người dùng"
HISTORY_BOT = "Trợ lý"
LISTING_USER = "[NGƯỜI DÙNG]"
LISTING_BOT = "[TRỢ LÝ]"
EXPORT_USER = "NGƯỜI DÙNG"
EXPORT_BOT = "TRỢ LÝ"
EXPORT_TITLE = "LỊCH SỬ CUỘC TRÒ CHUYỆN - Session: "
CONTEXT_HEAD = "Lịch sử:"
CONTEXT_QUESTION = "Câu hỏi mới: "
PROMPT_DOCUMENTS = "Tài liệu y tế:"
PROMPT_ASK = "Dựa vào tài liệu trên, trả lời câu hỏi: "
PROMPT_QUESTION = "Câu hỏi: "
PROMPT_NO_DOCUMENT = "(Không tìm thấy tài liệu liên quan, trả lời theo kiến thức chung)"
SYSTEM_DOMAIN = (
    "Bạn là trợ lý y tế AI. Trả lời chính xác dựa vào tài liệu y tế được cung cấp.\n"
    "QUAN TRỌNG:\n"
    "- Chỉ trả lời dựa vào thông tin y tế được cung cấp\n"
    "- Không bịa đặt thông tin\n"
    '- Nếu không có thông tin → nói "Tôi không có đủ thông tin"'
)
SYSTEM_CHAT = "Bạn là trợ lý AI thân thiện."
EMPTY_ANSWER = "Xin lỗi, tôi không thể trả lời câu hỏi này lúc này."
CHAT_SETTINGS = {"temperature": 0.7, "max_tokens": 150, "stop": "\n\n", "top_p": 0.9}
DOMAIN_SETTINGS = {"temperature": 0.3, "max_tokens": 2048, "stop": "Tài liệu:", "top_p": 0.9}
# Keyword fallback: (words looked for in the question, keywords it selects);
# the last entry is used when no other one applies.
KEYWORD_RULES = [
    (["tên", "gì"], ["tên", "là", "gọi"]),
    (["đau", "bệnh", "triệu chứng"], ["đau", "bị", "triệu chứng", "cảm thấy"]),
    ([], ["tôi", "mình", "bạn"]),
]

# --- instruction rows and chat templates ------------------------------------
WHAT_IS = " là gì?"
EXPLAIN = "Giải thích về "
EXPLAIN_OF = " của "
TAG_SYSTEM = "Bạn là trợ lý y tế chuyên nghiệp."
CHATML_DEFAULT_SIMPLE = "You are a helpful assistant."
CHATML_DEFAULT_FULL = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
TOOLS_LEAD = (
    "\n\n# Tools\n\nYou may call one or more functions to assist with the user query."
    "\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_TAIL = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    'within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, '
    '"arguments": <args-json-object>}\n</tool_call><|im_end|>\n'
)
IGNORE_LABEL = -100
