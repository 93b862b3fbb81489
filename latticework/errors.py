"""What can go wrong, by name. Every error is a ValueError."""

from __future__ import annotations


class LatticeError(ValueError):
    """Base of all errors; ``template`` is filled from the arguments."""

    template = "{0}"

    def __init__(self, *args: object, **named: object):
        self.details = dict(named)
        super().__init__(self.template.format(*args, **named))


def _error(name: str, template: str, base: type = LatticeError) -> type:
    return type(name, (base,), {"template": template, "__module__": __name__, "__doc__": template})


# What the texts of these two begin with.
EOS_DISALLOWED = "EOS token should not be inserted into Vocabulary"
BAD_JSON = "Expected a valid JSON string."

# Index
IndexDfaError = _error("IndexDfaError", "No automaton for the pattern: {0}")
DfaHasNoStartState = _error("DfaHasNoStartState", "The pattern looks at what stands before the text, so no one start state serves")
IncompatibleVocabulary = _error("IncompatibleVocabulary", "No token of the vocabulary leads on from state {error_state} of {regex!r}, where one of these has to follow: {missing_tokens}")
# Vocabulary
EOSTokenDisallowed = _error("EOSTokenDisallowed", EOS_DISALLOWED)
TokenizersError = _error("TokenizersError", "The tokenizer can't be read: {0}")
UnsupportedTokenizer = _error("UnsupportedTokenizer", "Tokenizers like that of {model} are not read: {reason}")
UnableToLocateEosTokenId = _error("UnableToLocateEosTokenId", "Nothing among the files of {model} names the token that ends a sequence")
UnsupportedByTokenProcessor = _error("UnsupportedByTokenProcessor", "The decoder is neither byte-level nor byte-fallback")
DecoderUnpackingFailed = _error("DecoderUnpackingFailed", "The decoder's parts can't be told apart")
ByteProcessorFailed = _error("ByteProcessorFailed", "A character of the token stands for no byte")
ByteFallbackProcessorFailed = _error("ByteFallbackProcessorFailed", "The token's hex digits name no byte")
# JSON Schema
SchemaSyntaxError = _error("SchemaSyntaxError", BAD_JSON + " {0}")
UnsupportedJsonSchema = _error("UnsupportedJsonSchema", "Schemas of this form have no pattern: {0}")
PropertiesNotFound = _error("PropertiesNotFound", "'properties' is missing or is no object")
MustBeAnArray = _error("MustBeAnArray", "'{0}' needs an array")
AllOfMustBeAnArray = _error("AllOfMustBeAnArray", "'allOf' needs an array", MustBeAnArray)
AnyOfMustBeAnArray = _error("AnyOfMustBeAnArray", "'anyOf' needs an array", MustBeAnArray)
OneOfMustBeAnArray = _error("OneOfMustBeAnArray", "'oneOf' needs an array", MustBeAnArray)
PrefixItemsMustBeAnArray = _error("PrefixItemsMustBeAnArray", "'prefixItems' needs an array", MustBeAnArray)
EnumMustBeAnArray = _error("EnumMustBeAnArray", "'enum' needs an array", MustBeAnArray)
UnsupportedEnumDataType = _error("UnsupportedEnumDataType", "An 'enum' can't hold {0}")
UnsupportedConstDataType = _error("UnsupportedConstDataType", "A 'const' can't be {0}")
ConstKeyNotFound = _error("ConstKeyNotFound", "'const' is missing")
RefMustBeAString = _error("RefMustBeAString", "'$ref' needs a string")
ExternalReferencesNotSupported = _error("ExternalReferencesNotSupported", "Only references within the schema are followed, not {0}")
InvalidReferenceFormat = _error("InvalidReferenceFormat", "{0} is no reference")
TypeMustBeAStringOrArray = _error("TypeMustBeAStringOrArray", "'type' needs a string or an array of strings")
UnsupportedType = _error("UnsupportedType", "There is no type {0}")
MaxBoundError = _error("MaxBoundError", "an upper bound lies below its lower bound")
StringTypeUnsupportedFormat = _error("StringTypeUnsupportedFormat", "There is no pattern for format {0}")
InvalidReferencePath = _error("InvalidReferencePath", "Nothing stands at {0}")
RefRecursionLimitReached = _error("RefRecursionLimitReached", "References go deeper than {0} levels")
