"""Sources: the contract index, provider envelopes and pages, the registry, the supplied tables."""
