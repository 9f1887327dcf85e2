"""DataFrame to DataFrame steps; each can be used alone or with ``transform``."""
