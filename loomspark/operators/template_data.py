"""Chat formats by name.

Fixed values: the strings below are what the named model families expect, character for
character. A slot list holds text (with {{content}} and, for one format, {{idx}}), BOS or EOS
for the tokenizer's own token if it has one, and Token(...) for one token of the vocabulary.
"""

from __future__ import annotations

from typing import NamedTuple


class Token(NamedTuple):
    text: str


BOS, EOS = "<<bos>>", "<<eos>>"
GMASK_SOP = [Token("[gMASK]"), Token("sop")]

# Shapes that several families share.
CHATML = {
    "user": ["<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n"],
    "assistant": ["{{content}}<|im_end|>\n"],
    "system": ["<|im_start|>system\n{{content}}<|im_end|>\n"],
    "stop_words": ["<|im_end|>"],
}
CHATML_TOOL = ["<|im_start|>tool\n{{content}}<|im_end|>\n<|im_start|>assistant\n"]
QWEN_TOOLS = {
    "function": ["{{content}}<|im_end|>\n"],
    "observation": ["<|im_start|>user\n<tool_response>\n{{content}}\n</tool_response><|im_end|>\n<|im_start|>assistant\n"],
    "tool_format": "qwen",
}
LLAMA3 = {
    "user": ["<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"],
    "assistant": ["{{content}}<|eot_id|>"],
    "system": ["<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>"],
    "function": ["{{content}}<|eot_id|>"],
    "observation": ["<|start_header_id|>ipython<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"],
    "prefix": [BOS],
    "stop_words": ["<|eot_id|>", "<|eom_id|>"],
    "tool_format": "llama3",
}
MISTRAL = {
    "user": ["[INST] {{content}}[/INST]"],
    "assistant": [" {{content}}", EOS],
    "system": ["{{content}}\n\n"],
    "function": ["[TOOL_CALLS] {{content}}", EOS],
    "observation": ['[TOOL_RESULTS] {"content": {{content}}}[/TOOL_RESULTS]'],
    "prefix": [BOS],
    "tool_format": "mistral",
    "system_in_user": True,
}
MINISTRAL = {
    "user": ["[INST]{{content}}[/INST]"],
    "system": ["{{content}}\n\n"],
    "function": ["[TOOL_CALLS]{{content}}", EOS],
    "observation": ['[TOOL_RESULTS]{"content": {{content}}}[/TOOL_RESULTS]'],
    "prefix": [BOS],
    "tool_format": "mistral",
    "system_in_user": True,
}
LLAMA2 = {
    "user": [BOS, "[INST] {{content}} [/INST]"],
    "system": ["<<SYS>>\n{{content}}\n<</SYS>>\n\n"],
    "system_in_user": True,
}
VICUNA = {
    "user": ["USER: {{content}} ASSISTANT:"],
    "default_system": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.",
}
GEMMA = {
    "user": ["<start_of_turn>user\n{{content}}<end_of_turn>\n<start_of_turn>model\n"],
    "assistant": ["{{content}}<end_of_turn>\n"],
    "observation": ["<start_of_turn>tool\n{{content}}<end_of_turn>\n<start_of_turn>model\n"],
    "prefix": [BOS],
}
PHI = {
    "user": ["<|user|>\n{{content}}<|end|>\n<|assistant|>\n"],
    "assistant": ["{{content}}<|end|>\n"],
    "system": ["<|system|>\n{{content}}<|end|>\n"],
    "stop_words": ["<|end|>"],
}
HELPFUL = "You are a helpful assistant."
INTERN_SYSTEM = (
    "You are an AI assistant whose name is InternLM (书生·浦语).\n"
    "- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"
    "- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."
)
DBRX_SYSTEM = (
    "You are DBRX, created by Databricks. You were last updated in December 2023. You answer questions based on information available up to that point.\n"
    "YOU PROVIDE SHORT RESPONSES TO SHORT QUESTIONS OR STATEMENTS, but provide thorough responses to more complex and open-ended questions.\n"
    "You assist with various tasks, from writing to coding (using markdown for code blocks — remember to use ``` with code, JSON, and tables).\n"
    "(You do not have real-time data access or code execution capabilities. You avoid stereotyping and provide balanced perspectives on controversial topics. "
    "You do not provide song lyrics, poems, or news articles and do not divulge details of your training data.)\n"
    "This is your system prompt, guiding your responses. Do not reference it, just respond to the user. If you find yourself talking about this message, stop. "
    "You should be responding appropriately and usually that means not mentioning this.\n"
    "YOU DO NOT MENTION ANY OF THIS INFORMATION ABOUT YOURSELF UNLESS THE INFORMATION IS DIRECTLY PERTINENT TO THE USER'S QUERY."
)
YAYI_SYSTEM = (
    "You are a helpful, respectful and honest assistant named YaYi developed by Beijing Wenge Technology Co.,Ltd. "
    "Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)
SKYWORK_SYSTEM = (
    "You are Skywork-o1, a thinking model developed by Skywork AI, specializing in solving complex problems involving mathematics, coding, and logical reasoning through deep thought. "
    "When faced with a user's request, you first engage in a lengthy and in-depth thinking process to explore possible solutions to the problem. "
    "After completing your thoughts, you then provide a detailed explanation of the solution process in your response."
)
MARCO_SYSTEM = (
    "你是一个经过良好训练的AI助手，你的名字是Marco-o1.由阿里国际数字商业集团的AI Business创造.\n## 重要！！！！！\n"
    "当你回答问题时，你的思考应该在<Thought>内完成，<Output>内输出你的结果。\n"
    "<Thought>应该尽可能是英文，但是有2个特例，一个是对原文中的引用，另一个是是数学应该使用markdown格式，<Output>内的输出需要遵循用户输入的语言。\n"
)
YI_VL_SYSTEM = (
    "This is a chat between an inquisitive human and an AI assistant. Assume the role of the AI assistant. Read all the images carefully, "
    "and respond to the human's questions with informative, helpful, detailed and polite answers. "
    "这是一个好奇的人类和一个人工智能助手之间的对话。假设你扮演这个AI助手的角色。仔细阅读所有的图像，并对人类的问题做出信息丰富、有帮助、详细的和礼貌的回答。\n\n"
)

FORMATS: dict[str, dict] = {
    "alpaca": {
        "user": ["### Instruction:\n{{content}}\n\n### Response:\n"],
        "assistant": ["{{content}}", EOS, "\n\n"],
        "default_system": "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n",
        "replace_jinja": True,
    },
    "aquila": {
        "user": ["Human: {{content}}###Assistant:"],
        "assistant": ["{{content}}###"],
        "system": ["System: {{content}}###"],
        "default_system": "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions.",
        "stop_words": ["</s>"],
    },
    "atom": {"user": [BOS, "Human: {{content}}\n", EOS, BOS, "Assistant:"], "assistant": ["{{content}}\n", EOS]},
    "baichuan": {"user": [Token("<reserved_102>"), "{{content}}", Token("<reserved_103>")], "efficient_eos": True},
    "baichuan2": {"user": ["<reserved_106>{{content}}<reserved_107>"], "efficient_eos": True},
    "belle": {"user": ["Human: {{content}}\n\nBelle: "], "assistant": ["{{content}}", EOS, "\n\n"], "prefix": [BOS]},
    "bluelm": {"user": [Token("[|Human|]:"), "{{content}}", Token("[|AI|]:")]},
    "breeze": {"user": ["[INST] {{content}} [/INST] "], "prefix": [BOS], "efficient_eos": True},
    "chatglm2": {"user": ["[Round {{idx}}]\n\n问：{{content}}\n\n答："], "prefix": GMASK_SOP, "efficient_eos": True},
    "chatglm3": {
        "user": [Token("<|user|>"), "\n", "{{content}}", Token("<|assistant|>")],
        "assistant": ["\n", "{{content}}"],
        "system": [Token("<|system|>"), "\n", "{{content}}"],
        "function": ["{{content}}"],
        "observation": [Token("<|observation|>"), "\n", "{{content}}", Token("<|assistant|>")],
        "tool_format": "glm4",
        "prefix": GMASK_SOP,
        "stop_words": ["<|user|>", "<|observation|>"],
        "efficient_eos": True,
    },
    "chatml": CHATML | {"observation": CHATML_TOOL, "stop_words": ["<|im_end|>", "<|im_start|>"], "replace_eos": True, "replace_jinja": True},
    "chatml_de": CHATML
    | {
        "observation": CHATML_TOOL,
        "default_system": "Du bist ein freundlicher und hilfsbereiter KI-Assistent.",
        "stop_words": ["<|im_end|>", "<|im_start|>"],
        "replace_eos": True,
        "replace_jinja": True,
    },
    "codegeex2": {"prefix": GMASK_SOP},
    "codegeex4": {
        "user": ["<|user|>\n{{content}}<|assistant|>\n"],
        "system": ["<|system|>\n{{content}}"],
        "function": ["{{content}}"],
        "observation": ["<|observation|>\n{{content}}<|assistant|>\n"],
        "tool_format": "glm4",
        "prefix": ["[gMASK]<sop>"],
        "default_system": "你是一位智能编程助手，你叫CodeGeeX。你会为用户回答关于编程、代码、计算机方面的任何问题，并提供格式规范、可以执行、准确安全的代码，并在必要时提供详细的解释。",
        "stop_words": ["<|user|>", "<|observation|>"],
        "efficient_eos": True,
    },
    "cohere": {
        "user": ["<|START_OF_TURN_TOKEN|><|USER_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|><|START_OF_TURN_TOKEN|><|CHATBOT_TOKEN|>"],
        "system": ["<|START_OF_TURN_TOKEN|><|SYSTEM_TOKEN|>{{content}}<|END_OF_TURN_TOKEN|>"],
        "prefix": [BOS],
    },
    "cpm": {"user": ["<用户>{{content}}<AI>"], "prefix": [BOS]},
    "cpm3": CHATML | {"prefix": [BOS]},
    "dbrx": CHATML | {"observation": CHATML_TOOL, "default_system": DBRX_SYSTEM},
    "deepseek": {"user": ["User: {{content}}\n\nAssistant:"], "system": ["{{content}}\n\n"], "prefix": [BOS]},
    "deepseek3": {"user": ["<｜User｜>{{content}}<｜Assistant｜>"], "prefix": [BOS]},
    "deepseekcoder": {
        "user": ["### Instruction:\n{{content}}\n### Response:"],
        "assistant": ["\n{{content}}\n<|EOT|>\n"],
        "prefix": [BOS],
        "default_system": (
            "You are an AI programming assistant, utilizing the DeepSeek Coder model, developed by DeepSeek Company, and you only answer questions related to computer science. "
            "For politically sensitive questions, security and privacy issues, and other non-computer science questions, you will refuse to answer.\n"
        ),
    },
    "default": {"user": ["Human: {{content}}\nAssistant:"], "assistant": ["{{content}}", EOS, "\n"], "system": ["System: {{content}}\n"]},
    "empty": {"assistant": ["{{content}}"]},
    "exaone": {"user": ["[|user|]{{content}}\n[|assistant|]"], "assistant": ["{{content}}", EOS, "\n"], "system": ["[|system|]{{content}}[|endofturn|]\n"]},
    "falcon": {"user": ["User: {{content}}\nFalcon:"], "assistant": ["{{content}}\n"], "efficient_eos": True},
    "fewshot": {"assistant": ["{{content}}\n\n"], "efficient_eos": True},
    "gemma": GEMMA,
    "glm4": {
        "user": ["<|user|>\n{{content}}<|assistant|>"],
        "assistant": ["\n{{content}}"],
        "system": ["<|system|>\n{{content}}"],
        "function": ["{{content}}"],
        "observation": ["<|observation|>\n{{content}}<|assistant|>"],
        "tool_format": "glm4",
        "prefix": ["[gMASK]<sop>"],
        "stop_words": ["<|user|>", "<|observation|>"],
        "efficient_eos": True,
    },
    "granite3": {
        "user": ["<|start_of_role|>user<|end_of_role|>{{content}}<|end_of_text|>\n<|start_of_role|>assistant<|end_of_role|>"],
        "assistant": ["{{content}}<|end_of_text|>\n"],
        "system": ["<|start_of_role|>system<|end_of_role|>{{content}}<|end_of_text|>\n"],
    },
    "index": {"user": ["reserved_0{{content}}reserved_1"], "system": ["<unk>{{content}}"], "efficient_eos": True},
    "intern": {
        "user": ["<|User|>:{{content}}\n<|Bot|>:"],
        "assistant": ["{{content}}<eoa>\n"],
        "system": ["<|System|>:{{content}}\n"],
        "prefix": [BOS],
        "default_system": INTERN_SYSTEM,
        "stop_words": ["<eoa>"],
    },
    "intern2": CHATML | {"prefix": [BOS], "default_system": INTERN_SYSTEM},
    "llama2": LLAMA2,
    "llama2_zh": LLAMA2 | {"default_system": "You are a helpful assistant. 你是一个乐于助人的助手。"},
    "llama3": LLAMA3,
    "mllama": LLAMA3 | {"mm_plugin": "mllama", "mm_tokens": {"image": "<|image|>"}},
    "llava": VICUNA | {"mm_plugin": "llava", "mm_tokens": {"image": "<image>"}},
    "llava_next": VICUNA | {"mm_plugin": "llava_next", "mm_tokens": {"image": "<image>"}},
    "llava_next_llama3": LLAMA3 | {"mm_plugin": "llava_next", "mm_tokens": {"image": "<image>"}},
    "llava_next_mistral": MISTRAL | {"mm_plugin": "llava_next", "mm_tokens": {"image": "<image>"}},
    "llava_next_qwen": CHATML | QWEN_TOOLS | {"default_system": HELPFUL, "mm_plugin": "llava_next", "mm_tokens": {"image": "<image>"}},
    "llava_next_yi": CHATML | {"mm_plugin": "llava_next", "mm_tokens": {"image": "<image>"}},
    "llava_next_video": VICUNA | {"mm_plugin": "llava_next_video", "mm_tokens": {"image": "<image>", "video": "<video>"}},
    "llava_next_video_mistral": MISTRAL | {"mm_plugin": "llava_next_video", "mm_tokens": {"image": "<image>", "video": "<video>"}},
    "llava_next_video_yi": CHATML | {"mm_plugin": "llava_next_video", "mm_tokens": {"image": "<image>", "video": "<video>"}},
    "marco": CHATML | {"observation": CHATML_TOOL, "default_system": MARCO_SYSTEM},
    "minicpm_v": CHATML | {"default_system": HELPFUL, "mm_plugin": "minicpm_v", "mm_tokens": {"image": "<image>", "video": "<video>"}},
    "minicpm_o": CHATML
    | {
        "default_system": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant.",
        "mm_plugin": "minicpm_v",
        "mm_tokens": {"image": "<image>", "video": "<video>", "audio": "<audio>"},
    },
    "ministral": MINISTRAL,
    "mistral": MISTRAL,
    "mistral_small": MINISTRAL | {"system": ["[SYSTEM_PROMPT]{{content}}[/SYSTEM_PROMPT]"], "system_in_user": False},
    "olmo": {"user": ["<|user|>\n{{content}}<|assistant|>\n"], "prefix": [EOS]},
    "openchat": {"user": ["GPT4 Correct User: {{content}}", EOS, "GPT4 Correct Assistant:"], "prefix": [BOS]},
    "openchat-3.6": {
        "user": ["<|start_header_id|>GPT4 Correct User<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>GPT4 Correct Assistant<|end_header_id|>\n\n"],
        "prefix": [BOS],
        "stop_words": ["<|eot_id|>"],
    },
    "opencoder": CHATML | {"observation": CHATML_TOOL, "default_system": "You are OpenCoder, created by OpenCoder Team."},
    "orion": {"user": ["Human: {{content}}\n\nAssistant: ", EOS], "prefix": [BOS]},
    "paligemma": GEMMA | {"mm_plugin": "paligemma", "mm_tokens": {"image": "<image>"}},
    "phi": PHI,
    "phi_small": PHI,
    "phi4": {
        "user": ["<|im_start|>user<|im_sep|>{{content}}<|im_end|><|im_start|>assistant<|im_sep|>"],
        "assistant": ["{{content}}<|im_end|>"],
        "system": ["<|im_start|>system<|im_sep|>{{content}}<|im_end|>"],
        "stop_words": ["<|im_end|>"],
    },
    "pixtral": MINISTRAL | {"mm_plugin": "pixtral", "mm_tokens": {"image": "[IMG]"}},
    "qwen": CHATML | QWEN_TOOLS | {"default_system": HELPFUL},
    "qwen2_audio": CHATML | {"default_system": HELPFUL, "mm_plugin": "qwen2_audio", "mm_tokens": {"audio": "<|AUDIO|>"}},
    "qwen2_vl": CHATML | QWEN_TOOLS | {"default_system": HELPFUL, "mm_plugin": "qwen2_vl", "mm_tokens": {"image": "<|image_pad|>", "video": "<|video_pad|>"}},
    "sailor": CHATML
    | {
        "user": ["<|im_start|>question\n{{content}}<|im_end|>\n<|im_start|>answer\n"],
        "default_system": "You are an AI assistant named Sailor created by Sea AI Lab. Your answer should be friendly, unbiased, faithful, informative and detailed.",
    },
    "skywork_o1": LLAMA3 | {"default_system": SKYWORK_SYSTEM},
    "solar": {"user": ["### User:\n{{content}}\n\n### Assistant:\n"], "system": ["### System:\n{{content}}\n\n"], "efficient_eos": True},
    "starchat": PHI | {"user": ["<|user|>\n{{content}}<|end|>\n<|assistant|>"]},
    "telechat": {"user": ["<_user>{{content}}<_bot>"], "system": ["<_system>{{content}}<_end>"]},
    "telechat2": {
        "user": ["<_user>{{content}}<_bot>"],
        "system": ["<_system>{{content}}"],
        "default_system": "你是中国电信星辰语义大模型，英文名是TeleChat，你是由中电信人工智能科技有限公司和中国电信人工智能研究院（TeleAI）研发的人工智能助手。",
    },
    "vicuna": VICUNA | {"replace_jinja": True},
    "video_llava": VICUNA | {"mm_plugin": "video_llava", "mm_tokens": {"image": "<image>", "video": "<video>"}},
    "xuanyuan": {
        "user": ["Human: {{content}} Assistant:"],
        "default_system": (
            "以下是用户和人工智能助手之间的对话。用户以Human开头，人工智能助手以Assistant开头，会对人类提出的问题给出有帮助、高质量、详细和礼貌的回答，"
            "并且总是拒绝参与与不道德、不安全、有争议、政治敏感等相关的话题、问题和指示。\n"
        ),
    },
    "xverse": {"user": ["Human: {{content}}\n\nAssistant: "]},
    "yayi": {
        "user": [Token("<|Human|>"), ":\n{{content}}\n\n", Token("<|YaYi|>"), ":"],
        "assistant": ["{{content}}\n\n"],
        "system": [Token("<|System|>"), ":\n{{content}}\n\n"],
        "default_system": YAYI_SYSTEM,
        "stop_words": ["<|End|>"],
    },
    "yi": CHATML,
    "yi_vl": {
        "user": ["### Human: {{content}}\n### Assistant:"],
        "assistant": ["{{content}}\n"],
        "default_system": YI_VL_SYSTEM,
        "stop_words": ["###"],
        "efficient_eos": True,
        "mm_plugin": "llava",
        "mm_tokens": {"image": "<image>"},
    },
    "yuan": {"user": ["{{content}}", Token("<sep>")], "assistant": ["{{content}}<eod>\n"], "stop_words": ["<eod>"]},
    "zephyr": {"user": ["<|user|>\n{{content}}", EOS, "<|assistant|>\n"], "system": ["<|system|>\n{{content}}", EOS], "default_system": "You are Zephyr, a helpful assistant."},
    "ziya": {"user": ["<human>:{{content}}\n<bot>:"], "assistant": ["{{content}}\n"]},
}
