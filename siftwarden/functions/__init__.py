"""Column functions: severity, text, versions, licences."""
