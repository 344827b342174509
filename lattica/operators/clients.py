"""Model clients for extraction. A client has ``invoke(prompt)``; extraction
makes one for each task, so the model loads once a task and only when used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass
class LocalModel:
    """A text-generation model in a local folder, through the transformers
    library if it is installed. The model is built at the first prompt; code
    that comes with model files is not run."""

    model_dir: str
    max_new_tokens: int = 768
    temperature: float = 0.1
    device: str = "auto"
    load_in_4bit: bool = False

    def __post_init__(self):
        self._pipeline = None

    def _build(self):
        try:
            import torch
            import transformers
        except ImportError as error:
            raise RuntimeError("LocalModel needs the transformers and torch libraries") from error
        gpu = torch.cuda.is_available()
        options: dict = {"device_map": self.device, "torch_dtype": torch.float16 if gpu else torch.float32}
        if self.load_in_4bit:
            options["quantization_config"] = transformers.BitsAndBytesConfig(load_in_4bit=True)
        tokenizer = transformers.AutoTokenizer.from_pretrained(self.model_dir)
        model = transformers.AutoModelForCausalLM.from_pretrained(self.model_dir, **options)
        return transformers.pipeline("text-generation", model=model, tokenizer=tokenizer, return_full_text=False)

    def invoke(self, prompt: str) -> object:
        if self._pipeline is None:
            self._pipeline = self._build()
        return self._pipeline(prompt, max_new_tokens=self.max_new_tokens, temperature=self.temperature, do_sample=self.temperature > 0)


def local_model(**options) -> Callable[[], LocalModel]:
    """A factory to give to ``extract``."""
    return lambda: LocalModel(**options)
