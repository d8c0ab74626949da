"""A catalog of model names: where each is found, and the chat template it takes."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Names that end in one of these, or multimodal ones, are tuned for chat.
CHAT_ENDINGS = ("-Chat", "-Distill", "-Instruct")


@dataclass
class ModelCatalog:
    """Display name -> locations by hub; a group's template holds for its chat models."""

    locations: dict[str, dict[str, str]] = field(default_factory=dict)
    templates: dict[str, str] = field(default_factory=dict)
    multimodal: set[str] = field(default_factory=set)

    def register_group(self, models: dict[str, dict[str, str]], template: str | None = None, multimodal: bool = False) -> None:
        for name, places in models.items():
            self.locations[name] = dict(places)
            if template and (multimodal or any(e in name for e in CHAT_ENDINGS)):
                self.templates[name] = template
            if multimodal:
                self.multimodal.add(name)

    def locate(self, name: str, hub: str = "huggingface") -> str:
        """A model's place on a hub; another hub's where it isn't there, the name itself if unknown."""
        places = self.locations.get(name)
        return name if not places else places.get(hub) or next(iter(places.values()))

    def template(self, name: str) -> str:
        return self.templates.get(name, "default")
