"""Errors of the package."""


class CorpusFlowError(Exception):
    """Base of all of them."""


class SettingsError(CorpusFlowError):
    """A setting has no valid value."""


class ToolError(CorpusFlowError):
    """A tool is unknown, is registered twice or can't take its arguments."""


class EngineError(CorpusFlowError):
    """A model could not be reached or gave no usable answer."""


class AgentError(CorpusFlowError):
    """An agent still asked for tools after its last round."""
