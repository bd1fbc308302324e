"""Options of an analysis and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Options:
    max_chars: int = 120_000
    max_input_tokens: int | None = None
    max_cost_usd: float | None = None
    token_estimation: str = "auto"
    template_dialect: str | None = None
    reference_heads: tuple[str, ...] = ()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    window_messages: int | None = None
    window_chars: int | None = None
    disabled_rules: tuple[str, ...] = ()
    strict_forward_refs: bool = False
    similarity_threshold: float = 0.6
    entailment_threshold: float = 0.7
    use_pattern: bool = True
    use_semantic: bool = False
    use_nli: bool = False
    use_nlp: bool = False
    use_combined: bool = False
    use_chunks: bool | None = None  # None: for contexts of more than 1000 characters
    use_sentences: bool = False
    use_phrases: bool = False
    use_many_hypotheses: bool = True
    combined_threshold: float = 0.5
    combine_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
    chunk_size: int = 500
    chunk_overlap: int = 100
    conflict_similarity: float = 0.3
    conflict_contradiction: float = 0.7

    def without(self, *codes: str) -> Options:
        """The same options with more rules switched off."""
        return replace(self, disabled_rules=tuple(dict.fromkeys([*self.disabled_rules, *codes])))

    def switched(self, enabled: dict[str, bool]) -> Options:
        """The same options with the rules switched off that the map denies."""
        return self.without(*[code for code, on in enabled.items() if not on])
