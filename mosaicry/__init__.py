"""mosaicry: media and document analytics as named DataFrame transformations."""
