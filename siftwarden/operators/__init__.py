"""DataFrame operators on findings, components, advisories and events."""
